"""Queries of metrics, importances, partial dependence, correlations, reports, and whole fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import metrics as M
from arborlake.functions.sampling import split
from arborlake.functions.scalars import significant
from arborlake.operators import analysis, auto
from arborlake.operators.forest import Feature, ForestClassifier, ForestRegressor
from arborlake.plans.config import Config
from arborlake.plans.queries_trees import _COLUMNS, forest
from arborlake.plans.registry import query, table
from arborlake.sources.files import shortened


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_quantity and a prediction of it from the price."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), F.round(F.col("l_extendedprice") / 1500).alias("p"))


@query(
    """WITH s AS (SELECT l_quantity AS y, round(l_extendedprice / 1500) AS p FROM lineitem)
    SELECT round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(-sqrt(avg((y - p) * (y - p))), 6) AS negative_rmse, round(avg((y - p) * (y - p)), 6) AS mse FROM s"""
)
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.round(M.r2("y", "p"), 6).alias("r2"), F.round(M.negative_rmse("y", "p"), 6).alias("negative_rmse"), F.round(M.mse("y", "p"), 6).alias("mse"))


_STATUS = "CASE WHEN o_totalprice > 150000 THEN 'O' WHEN o_totalprice > 75000 THEN 'F' ELSE 'P' END"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a guess of their status and probabilities of F, O and P."""
    guess = F.expr(_STATUS)
    probs = F.when(guess == "O", F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))).when(guess == "F", F.array(F.lit(0.6), F.lit(0.3), F.lit(0.1))).otherwise(F.array(F.lit(0.3), F.lit(0.3), F.lit(0.4)))
    orders = table(spark, sf_dir, "orders").withColumn("guess", guess).withColumn("probs", probs)
    place = F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")).cast("int")
    return orders.withColumn("true_p", F.when(place > 0, F.element_at("probs", F.when(place > 0, place))))


@query(
    f"""WITH o AS (SELECT o_orderstatus AS t, {_STATUS} AS g FROM orders), p AS (SELECT t, g, CASE g WHEN 'O' THEN [0.2, 0.7, 0.1] WHEN 'F' THEN [0.6, 0.3, 0.1] ELSE [0.3, 0.3, 0.4] END AS probs FROM o),
    q AS (SELECT CAST(probs[1] AS DOUBLE) AS a, CAST(probs[2] AS DOUBLE) AS b, CAST(probs[3] AS DOUBLE) AS c, CAST(CASE t WHEN 'F' THEN probs[1] WHEN 'O' THEN probs[2] WHEN 'P' THEN probs[3] END AS DOUBLE) AS tp, t = g AS hit FROM p)
    SELECT round(avg(a * a + b * b + c * c - 2 * coalesce(tp, 0.0) + 1), 6) AS brier, round(-avg(ln(tp)), 6) AS log_loss, round(avg(CAST(hit AS INTEGER)), 6) AS accuracy FROM q"""
)
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _classes(spark, sf_dir)
    return found.agg(F.round(M.brier("probs", F.col("true_p")), 6).alias("brier"), F.round(M.log_loss(F.col("true_p")), 6).alias("log_loss"), F.round(M.accuracy("o_orderstatus", "guess"), 6).alias("accuracy"))


@query(
    f"""WITH o AS (SELECT o_orderstatus AS t, {_STATUS} AS g FROM orders), c AS (SELECT t AS k FROM o UNION SELECT g FROM o)
    SELECT round(avg(f), 6) AS macro_f1 FROM (SELECT 2.0 * count(*) FILTER (t = k AND g = k) / (count(*) FILTER (t = k) + count(*) FILTER (g = k)) AS f FROM o, c GROUP BY k)"""
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = M.macro_f1(_classes(spark, sf_dir), "o_orderstatus", "guess")
    return doubled.select(F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT count(*) AS classes, round(max(s), 6) AS majority, round(min(s), 6) AS minority, round(-sum(s * ln(s)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS s FROM orders GROUP BY o_orderpriority)")
def target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.target_profile(table(spark, sf_dir, "orders"), "o_orderpriority")
    return found.select("classes", *(F.round(c, 6).alias(c) for c in ("majority", "minority", "entropy")))


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(CAST(count(DISTINCT o_totalprice) AS DOUBLE) / count(*), 6) AS unique_fraction FROM orders")
def numeric_target_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").agg(F.round(F.avg(y), 4).alias("mean"), F.round(F.stddev_pop(y), 4).alias("std"), F.round(F.count_distinct(y) / F.count("*"), 6).alias("unique_fraction"))


@query(
    """WITH c AS (SELECT c_nationkey AS dataset, c_mktsegment AS name, avg(c_acctbal) AS loss, sum(c_custkey) % 1000 AS predicted_loss FROM customer GROUP BY 1, 2)
    SELECT CAST(dataset AS INTEGER) AS dataset, arg_min(name, (predicted_loss, name)) AS chosen, round(arg_min(loss, (predicted_loss, name)) / min(loss) - 1, 6) AS regret FROM c GROUP BY 1"""
)
def advisor_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("dataset"), F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("loss"), (F.sum("c_custkey") % 1000).alias("predicted_loss"))
    return auto.advisor_regret(c).withColumn("regret", F.round("regret", 6))


@query(
    """WITH c AS (SELECT c_nationkey AS dataset, c_mktsegment AS name, avg(c_acctbal) AS loss FROM customer GROUP BY 1, 2), b AS (SELECT dataset, loss AS base FROM c WHERE name = 'BUILDING')
    SELECT CAST(dataset AS INTEGER) AS dataset, name, round(loss, 6) AS loss, round(loss / base - 1, 6) AS relative_loss FROM c JOIN b USING (dataset)"""
)
def advisor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("int").alias("dataset"), F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("loss"))
    return auto.advisor_features(c, baseline="BUILDING").select("dataset", "name", F.round("loss", 6).alias("loss"), F.round("relative_loss", 6).alias("relative_loss"))


def _value(tree: int, q: str, d: str, t: str) -> str:
    """SQL of a tree of the given forest, written out."""
    t_null = f"{t} IS NULL"
    return {
        0: f"CASE WHEN {q} <= 25 THEN (CASE WHEN {d} <= 0.05 THEN 6.0 ELSE 10.0 END) ELSE (CASE WHEN {t} = 0.02 THEN 16.0 ELSE 12.0 END) END",
        1: f"CASE WHEN {t_null} OR {t} <= 0.03 THEN (CASE WHEN {q} <= 10 THEN 6.0 ELSE 11.0 END) ELSE 13.0 END",
        2: f"CASE WHEN {d} = 0.07 THEN 15.0 ELSE 10.0 END",
    }[tree]


def _mean(q: str = "q", d: str = "d", t: str = "t") -> str:
    return "CAST(CAST(((" + ") + (".join(_value(i, q, d, t) for i in range(3)) + ")) / 3 AS FLOAT) AS DOUBLE)"


_SUPPLIERS = "s AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS q, CAST(s_nationkey % 10 / 100.0 AS DOUBLE) AS d, CAST(s_suppkey % 8 / 100.0 AS DOUBLE) AS t, CAST(s_acctbal / 1000 AS DOUBLE) AS y FROM supplier)"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("l_quantity"), (F.col("s_nationkey") % 10 / 100.0).alias("l_discount"), (F.col("s_suppkey") % 8 / 100.0).alias("l_tax"), (F.col("s_acctbal") / 1000).alias("y")
    )


def _md5(stream: str) -> str:
    return f"md5(concat('42:{stream}:', s_suppkey))"


def _r2(p: str) -> str:
    return f"1 - sum(power(y - ({p}), 2)) / (sum(y * y) - sum(y) * sum(y) / count(*))"


def _permutation_sql() -> str:
    parts = []
    for name, c in zip(_COLUMNS, "qdt", strict=True):
        for r in range(2):
            args = {x: (f"b.{x}" if x == c else f"a.{x}") for x in "qdt"}
            parts.append(
                f"""SELECT '{name}' AS feature, (SELECT {_r2(_mean())} FROM s) - (SELECT {_r2(_mean(args["q"], args["d"], args["t"])).replace("y", "a.y")}
                FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS pl FROM s) a JOIN (SELECT q, d, t, row_number() OVER (ORDER BY {_md5(f"permute:{name}:{r}")}, s_suppkey) AS pl FROM s) b USING (pl)) AS fall"""
            )
    return f"WITH {_SUPPLIERS}, f AS ({' UNION ALL '.join(parts)}) SELECT feature, round(avg(fall), 6) AS importance, round(stddev_pop(fall), 6) AS std FROM f GROUP BY 1"


@query(_permutation_sql())
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.permutation_importance(forest(spark), _suppliers(spark, sf_dir), "y", "s_suppkey", n_repeats=2, n_samples=None)
    return found.select("feature", F.round("importance", 6).alias("importance"), F.round("std", 6).alias("std"))


@query(f"WITH {_SUPPLIERS}, g AS (SELECT DISTINCT d AS g FROM s) SELECT g AS l_discount, round(avg({_mean(d='g')}), 5) AS average FROM s, g GROUP BY 1")
def pdp_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.partial_dependence(forest(spark), _suppliers(spark, sf_dir), "s_suppkey", "l_discount", n_samples=None).withColumn("average", F.round("average", 5))


@query(f"WITH {_SUPPLIERS}, g AS (SELECT DISTINCT t AS g FROM s) SELECT s_suppkey, g AS l_tax, round({_mean(t='g')}, 5) AS prediction FROM s, g")
def ice_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.partial_dependence(forest(spark), _suppliers(spark, sf_dir), "s_suppkey", "l_tax", n_samples=None, individual=True)
    return found.select("s_suppkey", "l_tax", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


@query(f"WITH {_SUPPLIERS}, g AS (SELECT DISTINCT d AS g FROM s), h AS (SELECT DISTINCT t AS h FROM s) SELECT g AS feature_1, h AS feature_2, round(avg({_mean(d='g', t='h')}), 5) AS average FROM s, g, h GROUP BY 1, 2")
def pdp_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.partial_dependence(forest(spark), _suppliers(spark, sf_dir), "s_suppkey", ["l_discount", "l_tax"], n_samples=None).withColumn("average", F.round("average", 5))


@query(f"WITH {_SUPPLIERS} SELECT 'l_discount' AS choice, round(avg({_mean(d='1', t='0')}), 5) AS average FROM s UNION ALL SELECT 'l_tax', round(avg({_mean(d='0', t='1')}), 5) FROM s")
def pdp_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.partial_dependence(forest(spark), _suppliers(spark, sf_dir), "s_suppkey", {"choice": ["l_discount", "l_tax"]}, n_samples=None).withColumn("average", F.round("average", 5))


@query(f"WITH {_SUPPLIERS} SELECT '(none)' AS flags, round(avg({_mean(d='0', t='0')}), 5) AS average FROM s UNION ALL SELECT 'l_discount', round(avg({_mean(d='1', t='0')}), 5) FROM s UNION ALL SELECT 'l_tax', round(avg({_mean(d='0', t='1')}), 5) FROM s")
def pdp_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = forest(spark)
    model.encoder.features.append(Feature("flags", "bundle", ["l_discount", "l_tax"]))
    try:
        groups = {f.name: f.sources for f in model.encoder.features if f.kind == "bundle"}
    finally:
        model.encoder.features.pop()
    return analysis.partial_dependence(model, _suppliers(spark, sf_dir), "s_suppkey", {"flags": ["(none)", *groups["flags"]]}, n_samples=None).withColumn("average", F.round("average", 5))


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH r AS (SELECT "
    + ", ".join(map(_rank, _LINE))
    + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM r" if a != b else f"SELECT '{a}' AS a, '{a}' AS b, CAST(1.0 AS DOUBLE) AS correlation" for a in _LINE for b in _LINE)
)
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.spearman(table(spark, sf_dir, "lineitem", *_LINE), _LINE).withColumn("correlation", F.round("correlation", 6))


@query("SELECT " + ", ".join(f"round({_rank(c).rsplit(' AS ', 1)[0]}, 1) AS {c}" for c in ("s_acctbal", "s_nationkey")) + " FROM supplier")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.average_ranks(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"])
    return found.select(*(F.round(c, 1).alias(c) for c in found.columns))


@query()
def linkage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "lineitem").withColumn("_key", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("l_quantity_copy", F.col("l_quantity") * 2)
    found = analysis.feature_relations(keyed, [*_LINE, "l_quantity_copy"], "_key", n_samples=None)
    return spark.createDataFrame([(i, ",".join(g)) for i, g in enumerate(analysis.related_groups(found))], "group_id long, members string")


@query(
    """SELECT 'r_name' AS "column", 'text' AS kind, count(DISTINCT r_name) = 1 AS constant FROM region UNION ALL SELECT 'r_regionkey', 'integer', count(DISTINCT r_regionkey) = 1 FROM region
    UNION ALL SELECT 'share', 'float', true UNION ALL SELECT 'fit_seconds', 'float', count(DISTINCT r_regionkey) = 1 FROM region"""
)
def csv_view_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the CSV viewer says of each column, found by aggregates rather than from collected rows."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name", F.lit("0.25").alias("share"), (F.col("r_regionkey") + 0.5).cast("string").alias("fit_seconds"))
    parts = []
    for c in region.columns:
        whole, number = F.bool_and(F.col(c).try_cast("bigint").isNotNull()), F.bool_and(F.col(c).try_cast("double").isNotNull())
        parts.append(F.struct(F.lit(c).alias("column"), F.when(whole, "integer").when(number, "float").otherwise("text").alias("kind"), (F.count_distinct(c) == 1).alias("constant")))
    return region.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


@query("SELECT * FROM (VALUES ('loss', '0.123456', '0.1235'), ('loss', '0.00123456', '0.001235'), ('fit_seconds', '1.23456', '1.23'), ('fit_seconds', '2.34567', '2.35'), ('n', '123456.0', '1.235e5'), ('n', '0.0000123', '1.230e-5')) t(name, value, shown)")
def csv_view_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("loss", "0.123456"), ("loss", "0.00123456"), ("fit_seconds", "1.23456"), ("fit_seconds", "2.34567"), ("n", "123456.0"), ("n", "0.0000123")]
    assert significant(0.0, 4) == "0"
    return spark.createDataFrame([(n, v, shortened(n, v, "float")) for n, v in cases], "name string, value string, shown string")


@query(
    """SELECT p_type, p_brand, round(avg(p_retailprice) + 0.0001, 1) AS price, rank() OVER (PARTITION BY p_type ORDER BY round(avg(p_retailprice) + 0.0001, 1) DESC) = 1 AS best FROM part GROUP BY 1, 2"""
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's cells, with the best of each group after rounding."""
    from pyspark.sql.window import Window

    cells = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice") + 0.0001, 1).alias("price"))
    return cells.withColumn("best", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("price"))) == 1)


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("_row"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice")


@query()
def forest_regression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits 80 % of lineitem, default budget, and measures the rest."""
    train, valid = split(_line_rows(spark, sf_dir), 0.8, 42, "_row")
    model = ForestRegressor(seed=42).fit(train, "l_extendedprice", key="_row")
    return model.transform(valid).agg(M.r2("l_extendedprice", "prediction").alias("r2"), M.negative_rmse("l_extendedprice", "prediction").alias("negative_rmse"), F.count("*").alias("n"))


@query()
def forest_class_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits 80 % of orders, default budget, and measures the rest."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    train, valid = split(orders, 0.8, 42, "o_orderkey")
    model = ForestClassifier(seed=42).fit(train, "o_orderstatus", key="o_orderkey")
    return model.transform(valid).agg(M.accuracy("o_orderstatus", "prediction").alias("accuracy"), F.count("*").alias("n"))


@query()
def forest_oob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-bag means and counts of a forest that tracks them."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    return ForestRegressor(seed=1, n_trees=16, oob=True).fit(part, "p_retailprice", key="p_partkey").oob_.select("row_id", "y", F.col("mean")[0].alias("mean"), "count")


@query()
def autogrow_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    grown = auto.AutoForest(autogrow=True, tree_batch_size=8, max_trees=24, seed=1)
    grown.fit(part, "p_retailprice", key="p_partkey")
    return spark.createDataFrame([(h["trees"], h["loss"], h["improvement"], h["accepted"]) for h in grown.tree_history_], "trees long, loss double, improvement double, accepted boolean")


@query()
def screen_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    suite = auto.forest_suite(Config(seed=1), {"min_node_size": [4, 16], "max_node_samples": [80]})
    return auto.screen(ForestRegressor(seed=1), part, "p_retailprice", suite, key="p_partkey")


@query()
def validate_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")
    train, valid = split(part, 0.8, 1, "p_partkey")
    suite = auto.forest_suite(Config(seed=1, n_trees=8), {"min_node_size": [16]})
    return auto.validate(ForestRegressor(seed=1), train, valid, "p_retailprice", suite, key="p_partkey")


@query()
def drop_column_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_retailprice")
    train, valid = split(part, 0.8, 1, "p_partkey")
    return analysis.drop_column_importance(ForestRegressor(seed=1, n_trees=8), train, valid, "p_retailprice", "p_partkey")


@query()
def feature_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("copy", F.col("s_acctbal") * 2)
    return analysis.feature_dependence(supplier, ["s_nationkey", "s_acctbal", "copy"], "s_suppkey", n_samples=None, n_trees=8)


@query()
def random_joint_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = auto.random_suite(Config(seed=1), {"min_node_size": [4, 8, 16], "max_features": [0.5, 0.9], "max_node_samples": [160, 320]}, 6)
    return spark.createDataFrame([(s.name, s.config.min_node_size, float(s.config.max_features), s.config.max_node_samples) for s in suite], "name string, min_node_size int, max_features double, max_node_samples int")


@query()
def column_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encoder learned of each column of orders: kinds, dates, cardinalities."""
    from arborlake.operators.forest import Encoder

    orders = table(spark, sf_dir, "orders").withColumn("o_clerk", F.lit("one"))
    return Encoder.fit(orders, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_clerk"], Config(seed=1), "o_orderkey").column_info(spark)


@query()
def ml_comparison_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed, one-hot and target-encoded features for comparing with other learners."""
    from pyspark.ml.functions import vector_to_array

    from arborlake.operators.compare import comparison_pipeline

    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")))
    made = comparison_pipeline(orders, ["o_totalprice"], ["o_orderpriority", "o_orderstatus"], "o_custkey", onehot_max=3).fit(orders).transform(orders)
    return made.select("o_orderkey", F.size(vector_to_array("features")).alias("width"), F.round(vector_to_array("features")[0], 4).alias("first"))
