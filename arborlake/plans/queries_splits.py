"""Queries of histograms, ordered passes, split scores and the best splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import histogram as H
from arborlake.plans.registry import query, table

#: Features of lineitem that the split queries search, as SQL and as columns; all are numbers.
FEATURES = {
    "f0_price": ("floor(l_extendedprice / 1000)", lambda: F.floor(F.col("l_extendedprice") / 1000)),
    "f1_discount": ("round(l_discount * 100)", lambda: F.round(F.col("l_discount") * 100)),
    "f2_flag": ("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END", lambda: F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2)),
    "f3_tax": ("round(l_tax * 100)", lambda: F.round(F.col("l_tax") * 100)),
}


def lineitem_features() -> dict:
    return {name: c() for name, (_, c) in FEATURES.items()}


def long_sql(keep: str, source: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{name}' AS feature, CAST({sql} AS DOUBLE) AS value FROM {source}" for name, (sql, _) in FEATURES.items())


def _loss_sql(n: str, s: str, q: str, prior: float) -> str:
    pull = f" + power({prior} / ({n} + {prior}), 2) * power({s} / {n} - ts / tn, 2)" if prior else ""
    return f"CASE WHEN {n} > 0 THEN -sqrt((CASE WHEN {n} > 1 THEN greatest(0.0, ({q} - {s} * {s} / {n}) / ({n} - 1)) ELSE 0.0 END){pull}) ELSE 0.0 END"


def running_sql(by: str, sums: tuple[str, ...]) -> str:
    """From hist(by, feature, value, sums): sums up to a value (c), of all (t), and of missing (m)."""
    part = f"PARTITION BY {by}, feature"
    columns = ", ".join(
        f"sum(CASE WHEN value IS NOT NULL THEN {c} END) OVER ({part} ORDER BY value NULLS FIRST ROWS UNBOUNDED PRECEDING) AS c{c}, sum({c}) OVER ({part}) AS t{c}, coalesce(sum(CASE WHEN value IS NULL THEN {c} END) OVER ({part}), 0.0) AS m{c}"
        for c in sums
    )
    return f"SELECT * FROM (SELECT *, {columns}, min(value) OVER ({part}) AS first_value_, max(value) OVER ({part}) AS last_value_ FROM hist) WHERE value IS NOT NULL"


def candidates_sql(by: str, sums: tuple[str, ...]) -> str:
    """From run: a row for each candidate split."""
    keep = f"{by}, feature, value AS cut, " + ", ".join(f"t{c}" for c in sums)
    le = ", ".join(f"c{c} AS l{c}" for c in sums)
    left = ", ".join(f"c{c} + m{c} AS l{c}" for c in sums)
    eq = ", ".join(f"{c} AS l{c}" for c in sums)
    return f"""SELECT 0 AS kind_order, 'le' AS kind, {keep}, {le} FROM run WHERE value < last_value_ OR mn > 0
        UNION ALL SELECT 1, 'le_missing_left', {keep}, {left} FROM run WHERE value < last_value_ AND mn > 0
        UNION ALL SELECT 2, 'eq', {keep}, {eq} FROM run WHERE value > first_value_ AND value < last_value_"""


def best_sql(long: str, by: str, prior: float = 3.0) -> str:
    """CTEs long, hist, run, cand, scored and best: the best regression split of each node."""
    right = {c: f"(t{c} - l{c})" for c in "nsq"}
    return f"""long AS ({long}),
    hist AS (SELECT {by}, feature, value, CAST(count(*) AS DOUBLE) AS n, sum(CAST(y AS DOUBLE)) AS s, sum(CAST(y * y AS DOUBLE)) AS q FROM long GROUP BY ALL),
    run AS ({running_sql(by, ("n", "s", "q"))}),
    cand AS ({candidates_sql(by, ("n", "s", "q"))}),
    scored AS (SELECT *, (ln * ({_loss_sql("ln", "ls", "lq", prior)}) + {right["n"]} * ({_loss_sql(right["n"], right["s"], right["q"], prior)})) / tn AS score, {_loss_sql("tn", "ts", "tq", prior)} AS parent FROM cand),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, feature, kind_order, cut) AS pl FROM scored WHERE round(score, 9) > round(parent, 9)) WHERE pl = 1)"""


_SHOWN = "feature, kind, cut, CAST(ln AS BIGINT) AS n_left, CAST(tn AS BIGINT) AS n, round(score, 6) AS score, round(greatest(0.0, score - parent), 6) AS gain"


def shown(best: DataFrame, *by: str) -> DataFrame:
    return best.select(*by, "feature", "kind", "cut", F.col("l_n").cast("long").alias("n_left"), F.col("t_n").cast("long").alias("n"), F.round("score", 6).alias("score"), F.round("gain", 6).alias("gain"))


def _lineitem_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("node", F.lit(0).cast("long"))
    return H.long_form(rows, lineitem_features(), ["node", "l_quantity"])


_LONG = long_sql("CAST(0 AS BIGINT) AS node, l_quantity AS y")


@query(f"WITH {best_sql(_LONG, 'node')} SELECT node, {_SHOWN} FROM best")
def best_split_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = H.regression_histogram(_lineitem_long(spark, sf_dir), ["node"], "l_quantity")
    return shown(H.best(H.regression_splits(hist, ["node"]), ["node"]), "node")


@query(f"WITH {best_sql(_LONG, 'node', 0)} SELECT node, {_SHOWN} FROM best")
def best_split_regression_prior0(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = H.regression_histogram(_lineitem_long(spark, sf_dir), ["node"], "l_quantity")
    return shown(H.best(H.regression_splits(hist, ["node"], 0), ["node"]), "node")


_BY_NODE = long_sql("l_suppkey AS node, l_quantity AS y")


@query(f"WITH {best_sql(_BY_NODE, 'node')} SELECT node, {_SHOWN} FROM best")
def best_split_of_many_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("node", F.col("l_suppkey"))
    hist = H.regression_histogram(H.long_form(rows, lineitem_features(), ["node", "l_quantity"]), ["node"], "l_quantity")
    return shown(H.best(H.regression_splits(hist, ["node"]), ["node"]), "node")


@query(f"WITH long AS ({_LONG}) SELECT node, feature, value, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS q FROM long GROUP BY ALL")
def hist_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.regression_histogram(_lineitem_long(spark, sf_dir), ["node"], "l_quantity")


_ORDERS = {"f0_price": ("floor(o_totalprice / 10000)", lambda: F.floor(F.col("o_totalprice") / 10_000)), "f1_month": ("month(o_orderdate)", lambda: F.month("o_orderdate")), "f2_year": ("year(o_orderdate)", lambda: F.year("o_orderdate"))}
_ORDERS_LONG = " UNION ALL ".join(f"SELECT CAST(0 AS BIGINT) AS node, o_orderstatus AS label, '{n}' AS feature, CAST({s} AS DOUBLE) AS value FROM orders" for n, (s, _) in _ORDERS.items())


def _orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("node", F.lit(0).cast("long")).withColumn("label", F.col("o_orderstatus"))
    return H.long_form(rows, {n: c() for n, (_, c) in _ORDERS.items()}, ["node", "label"])


@query(f"WITH long AS ({_ORDERS_LONG}) SELECT node, feature, value, label, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY ALL")
def hist_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.class_histogram(_orders_long(spark, sf_dir), ["node"], "label")


_EVENTS_LONG = "SELECT event_type AS node, 'value' AS feature, CASE WHEN value <= 400 THEN floor(value / 10) END AS value, user_id % 97 AS y FROM events"


def _events_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("node", F.col("event_type")).withColumn("y", F.col("user_id") % 97)
    return H.regression_histogram(H.long_form(rows, {"value": F.when(F.col("value") <= 400, F.floor(F.col("value") / 10))}, ["node", "y"]), ["node"], "y")


_EVENTS_RUN = f"""WITH long AS ({_EVENTS_LONG}), hist AS (SELECT node, feature, value, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS s, CAST(sum(y * y) AS DOUBLE) AS q FROM long GROUP BY ALL),
    run AS ({running_sql("node", ("n", "s", "q"))})"""


@query(f"{_EVENTS_RUN} SELECT node, value, cn AS upto_n, cs AS upto_s, cq AS upto_q, tn AS all_n, mn AS missing_n FROM run")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = H._running(_events_hist(spark, sf_dir), ["node"], ["n", "s", "q"])
    return run.select("node", "value", F.col("c_n").alias("upto_n"), F.col("c_s").alias("upto_s"), F.col("c_q").alias("upto_q"), F.col("t_n").alias("all_n"), F.col("m_n").alias("missing_n"))


def _kind(name: str, keep: str, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        splits = H.regression_splits(_events_hist(spark, sf_dir), ["node"])
        return splits.filter(F.col("kind") == kind).select("node", "cut", F.col("l_n").alias("left_n"), F.col("l_s").alias("left_s"), F.round("score", 6).alias("score"))

    run.__name__ = name
    right = {c: f"(t{c} - l{c})" for c in "nsq"}
    sql = f"""{_EVENTS_RUN}, cand AS ({candidates_sql("node", ("n", "s", "q"))})
        SELECT node, cut, ln AS left_n, ls AS left_s, round((ln * ({_loss_sql("ln", "ls", "lq", 3.0)}) + {right["n"]} * ({_loss_sql(right["n"], right["s"], right["q"], 3.0)})) / tn, 6) AS score FROM cand WHERE kind = '{kind}'"""
    return query(sql)(run)


missing_right_candidates = _kind("missing_right_candidates", "", "le")
missing_left_candidates = _kind("missing_left_candidates", "", "le_missing_left")
equality_candidates = _kind("equality_candidates", "", "eq")


@query(f"WITH {best_sql(_EVENTS_LONG, 'node')} SELECT node, {_SHOWN} FROM best")
def best_split_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(H.best(H.regression_splits(_events_hist(spark, sf_dir), ["node"]), ["node"]), "node")


_WEIGHTS = """w AS (SELECT o_orderstatus AS label, frequency, power(frequency, -0.75) / sum(frequency * power(frequency, -0.75)) OVER () AS weight
    FROM (SELECT o_orderstatus, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS frequency FROM orders GROUP BY 1))"""


@query(f"WITH {_WEIGHTS} SELECT label AS o_orderstatus, round(frequency, 9) AS frequency, round(weight, 9) AS weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus", 0.75).select("o_orderstatus", F.round("frequency", 9).alias("frequency"), F.round("weight", 9).alias("weight"))


def _term(m: str) -> str:
    return f"CASE WHEN {m} > 1e-9 THEN {m} * ln({m}) ELSE 0.0 END"


def class_best_sql(long: str) -> str:
    """CTEs long, own, grid, hist, run, cand, sums, scored and best: the best class split of each node."""
    return f"""long AS ({long}),
    own AS (SELECT node, feature, value, label, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY ALL),
    grid AS (SELECT DISTINCT node, feature, value, w.label, weight FROM own, w),
    hist AS (SELECT concat(grid.node, ':', grid.label) AS nl, grid.node, grid.label, grid.feature, grid.value, coalesce(n, 0.0) AS n, coalesce(n, 0.0) * weight AS m FROM grid LEFT JOIN own USING (node, feature, value, label)),
    run AS ({running_sql("nl, node, label", ("n", "m"))}),
    cand AS ({candidates_sql("nl, node, label", ("n", "m"))}),
    sums AS (SELECT node, feature, cut, kind, kind_order, sum(ln) AS ln, sum(tn) AS tn, sum(lm) AS ml, sum(tm) AS mt, sum({_term("lm")}) AS el, sum({_term("(tm - lm)")}) AS er, sum({_term("tm")}) AS et FROM cand GROUP BY ALL),
    scored AS (SELECT *, (el - {_term("ml")} + er - {_term("(mt - ml)")}) / mt AS score, (et - {_term("mt")}) / mt AS parent FROM sums WHERE ln > 0 AND ln < tn),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(score, 9) DESC, feature, kind_order, cut) AS pl FROM scored WHERE round(score, 9) > round(parent, 9)) WHERE pl = 1)"""


_CLASS_BEST = f"WITH {_WEIGHTS}, {class_best_sql(_ORDERS_LONG)}"


@query(f"{_CLASS_BEST} SELECT node, {_SHOWN} FROM best")
def best_split_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = H.class_weights(table(spark, sf_dir, "orders").withColumn("label", F.col("o_orderstatus")), "label", 0.75).select("label", "weight")
    hist = H.class_histogram(_orders_long(spark, sf_dir), ["node"], "label")
    return shown(H.best(H.class_splits(hist, ["node"], "label", weights), ["node"]), "node")


@query(
    """SELECT l_suppkey AS node, count(*) < 8 OR max(l_quantity) - min(l_quantity) <= 1e-8 + 1e-5 * abs(min(l_quantity)) AS stops, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1"""
)
def stop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_quantity")
    same = F.max(y) - F.min(y) <= 1e-8 + 1e-5 * F.abs(F.min(y))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(((F.count("*") < 8) | same).alias("stops"), F.count("*").alias("n"), F.round(F.avg(y), 6).alias("mean"))


@query("SELECT o_custkey % 20 AS node, o_orderstatus AS label, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_custkey % 20), 9) AS share FROM orders GROUP BY 1, 2")
def leaf_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    counts = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("node"), F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    return counts.select("node", "label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("node")), 9).alias("share"))




@query(
    f"""WITH c AS (SELECT unnest([10, 20, 30, 40, 50]) AS cut), s AS (SELECT cut, count(*) FILTER (floor(l_extendedprice / 1000) <= cut) AS n_left, CAST(sum(l_quantity) FILTER (floor(l_extendedprice / 1000) <= cut) AS DOUBLE) AS sum_left, count(*) AS n FROM lineitem, c GROUP BY cut)
    SELECT CAST(cut AS DOUBLE) AS cut, n_left, sum_left, n FROM s"""
)
def random_splitter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = (10.0, 20.0, 30.0, 40.0, 50.0)
    price, y = F.floor(F.col("l_extendedprice") / 1000), F.col("l_quantity")
    sums = [F.struct(F.lit(c).alias("cut"), F.count_if(price <= c).alias("n_left"), F.sum(F.when(price <= c, y)).alias("sum_left"), F.count("*").alias("n")) for c in cuts]
    return table(spark, sf_dir, "lineitem").agg(F.array(*sums).alias("a")).select(F.explode("a").alias("x")).select("x.*")
