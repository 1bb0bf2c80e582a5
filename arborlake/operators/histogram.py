"""Histograms, ordered passes over them, and split scores, all as DataFrame aggregates and windows.

Rows are in long form: a row for each node, feature and training row with ``value`` (null: missing) and the
target. One hash aggregation makes all nodes' and features' histograms; windows over a node's and feature's
few distinct values give the running sums. The shuffle keys are (node, feature, value), so neither a large
node nor a frequent value gathers rows: they are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of splits, in the order that breaks ties: values up to the cut go left and missing right; the same
#: with missing left; values equal to the cut go left.
KINDS = ("le", "le_missing_left", "eq")


def long_form(df: DataFrame, features: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each feature of each row: keep, feature, value. One scan, one explode."""
    pairs = F.array(*(F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value")) for name, value in features.items()))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def regression_histogram(rows: DataFrame, by: list[str], y: str, weight: str | None = None) -> DataFrame:
    """n, s and q (count, sum, sum of squares of y) for each node, feature and value."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(y).cast("double")
    return rows.groupBy(*by, "feature", "value").agg(F.sum(w).cast("double").alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"))


def class_histogram(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """n for each node, feature, value and class."""
    return rows.groupBy(*by, "feature", "value", label).agg(F.count("*").cast("double").alias("n"))


def side_loss(n: Column, s: Column, q: Column, mean: Column, prior: float) -> Column:
    """-sqrt(sample variance + (k / (n + k))^2 (side mean - node mean)^2); an empty side has 0."""
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))).otherwise(0.0)
    pull = (F.lit(float(prior)) / (n + prior)) ** 2 * (s / n - mean) ** 2 if prior else F.lit(0.0)
    return F.when(n > 0, -F.sqrt(variance + pull)).otherwise(0.0)


def _running(hist: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """hist with, for each value, all sums up to it (c_), of the node and feature (t_) and of missing (m_)."""
    group = Window.partitionBy(*by, "feature")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present, missing = F.col("value").isNotNull(), F.col("value").isNull()
    out = hist
    for c in sums:
        out = out.withColumn(f"c_{c}", F.sum(F.when(present, F.col(c))).over(upto)).withColumn(f"t_{c}", F.sum(c).over(group))
        out = out.withColumn(f"m_{c}", F.coalesce(F.sum(F.when(missing, F.col(c))).over(group), F.lit(0.0)))
    return out.withColumn("first", F.min("value").over(group)).withColumn("last", F.max("value").over(group)).filter(present)


def _sides(running: DataFrame, by: list[str], sums: list[str], total: str = "n") -> DataFrame:
    """A row for each candidate split: kind, cut, sums of its left side (l_) and of all (t_)."""
    left = {
        "le": {c: F.col(f"c_{c}") for c in sums},
        "le_missing_left": {c: F.col(f"c_{c}") + F.col(f"m_{c}") for c in sums},
        "eq": {c: F.col(c) for c in sums},
    }
    usable = {
        "le": (F.col("value") < F.col("last")) | (F.col(f"m_{total}") > 0),
        "le_missing_left": (F.col("value") < F.col("last")) & (F.col(f"m_{total}") > 0),
        "eq": (F.col("value") > F.col("first")) & (F.col("value") < F.col("last")),
    }
    made = [F.when(usable[k], F.struct(F.lit(i).alias("kind_order"), F.lit(k).alias("kind"), *(left[k][c].alias(f"l_{c}") for c in sums))) for i, k in enumerate(KINDS)]
    some = running.withColumn("x", F.explode(F.array_compact(F.array(*made))))
    return some.select(*by, "feature", F.col("value").alias("cut"), "x.*", *(f"t_{c}" for c in sums))


def regression_splits(hist: DataFrame, by: list[str], prior: float = 3.0) -> DataFrame:
    """Every candidate with its score, the node's own score, and what it gains."""
    sums = ["n", "s", "q"]
    c = _sides(_running(hist, by, sums), by, sums)
    mean = F.col("t_s") / F.col("t_n")
    right = {x: F.col(f"t_{x}") - F.col(f"l_{x}") for x in sums}
    left_score = F.col("l_n") * side_loss(F.col("l_n"), F.col("l_s"), F.col("l_q"), mean, prior)
    right_score = right["n"] * side_loss(right["n"], right["s"], right["q"], mean, prior)
    scored = c.withColumn("score", (left_score + right_score) / F.col("t_n"))
    scored = scored.withColumn("parent", side_loss(F.col("t_n"), F.col("t_s"), F.col("t_q"), mean, prior))
    return scored.withColumn("gain", F.greatest(F.lit(0.0), F.col("score") - F.col("parent")))


def _entropy_term(m: Column) -> Column:
    return F.when(m > 0, m * F.log(m)).otherwise(0.0)


def class_splits(hist: DataFrame, by: list[str], label: str, weights: DataFrame) -> DataFrame:
    """As regression_splits for classes: weights has (label, weight); scores are weighted entropies."""
    dense = hist.join(F.broadcast(weights), label).withColumn("m", F.col("n") * F.col("weight"))
    per_value = dense.groupBy(*by, "feature", "value").agg(F.collect_list(F.struct(label, "n", "m")).alias("own"))
    # running sums of each class, then a row for each value and class
    classes = weights.select(label)
    grid = per_value.select(*by, "feature", "value").join(F.broadcast(classes), how="cross")
    full = grid.alias("g").join(dense.alias("d"), [F.col(f"g.{b}").eqNullSafe(F.col(f"d.{b}")) for b in [*by, "feature", "value", label]], "left")
    full = full.select(*(F.col(f"g.{b}").alias(b) for b in [*by, "feature", "value", label]), F.coalesce("d.n", F.lit(0.0)).alias("n"), F.coalesce("d.m", F.lit(0.0)).alias("m"))
    parts = _sides(_running(full, [*by, label], ["n", "m"]), [*by, label], ["n", "m"])
    key = [*by, "feature", "cut", "kind", "kind_order"]
    right = F.col("t_m") - F.col("l_m")
    scored = parts.groupBy(*key).agg(
        F.sum("l_n").alias("l_n"), F.sum("t_n").alias("t_n"), F.sum("l_m").alias("ml"), F.sum("t_m").alias("mt"),
        F.sum(_entropy_term(F.col("l_m"))).alias("el"), F.sum(_entropy_term(F.greatest(right, F.lit(0.0)))).alias("er"), F.sum(_entropy_term(F.col("t_m"))).alias("et"),
    )
    scored = scored.filter((F.col("l_n") > 0) & (F.col("l_n") < F.col("t_n")))
    mr = F.col("mt") - F.col("ml")
    scored = scored.withColumn("score", (F.col("el") - _entropy_term(F.col("ml")) + F.col("er") - _entropy_term(mr)) / F.col("mt"))
    scored = scored.withColumn("parent", (F.col("et") - _entropy_term(F.col("mt"))) / F.col("mt"))
    return scored.withColumn("gain", F.greatest(F.lit(0.0), F.col("score") - F.col("parent")))


def best(splits: DataFrame, by: list[str]) -> DataFrame:
    """The best candidate of each node that beats the node itself; ties: feature, kind, cut, in this order."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "feature", "kind_order", "cut")
    better = splits.filter(F.round(F.col("score"), 9) > F.round(F.col("parent"), 9))
    return better.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at")


def class_weights(df: DataFrame, label: str, power: float) -> DataFrame:
    """(label, frequency, weight): (n_c / N)^-power, scaled so that frequency times weight sums to 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_rows = Window.partitionBy()
    shares = counts.withColumn("frequency", F.col("n") / F.sum("n").over(all_rows)).withColumn("raw", F.col("frequency") ** -power)
    return shares.select(label, "frequency", (F.col("raw") / F.sum(F.col("frequency") * F.col("raw")).over(all_rows)).alias("weight"))


def route(rows: DataFrame, splits: DataFrame, features: dict[str, Column], node: str = "node") -> DataFrame:
    """Rows one level down: node 2n + 1 on the left of its split and 2n + 2 on the right; leaves stay.

    splits has a row a node; a level of at most a few thousand nodes is what makes it fit to broadcast.
    """
    value = F.coalesce(*(F.when(F.col("_s.feature") == name, c.cast("double")) for name, c in features.items()))
    right = F.when(value.isNull(), F.col("_s.kind") != "le_missing_left").when(F.col("_s.kind") == "eq", value != F.col("_s.cut")).otherwise(value > F.col("_s.cut"))
    small = F.broadcast(splits.select(F.col(node).alias("_node"), F.struct("feature", "kind", "cut").alias("_s")))
    moved = rows.join(small, F.col(node) == F.col("_node"), "left")
    child = F.when(F.col("_s").isNull(), F.col(node)).otherwise(2 * F.col(node) + 1 + right.cast("int"))
    return moved.withColumn(node, child).drop("_node", "_s")
