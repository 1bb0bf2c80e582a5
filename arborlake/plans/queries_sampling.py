"""Queries of planning, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.functions.sampling import bernoulli, hash_key, hash_number, permuted, sample_rows, split, split_final_rows, take_rows, tree_draws, tree_samples
from arborlake.plans.config import Config, features_per_node, plan_fit, resolve_replacement
from arborlake.plans.registry import query, table

_PLANS = [(1_000_000, 20, 20_000), (1_000_000, None, 40_000), (1_000_000, None, 240_000), (10_000, None, 40_000), (50, None, 40_000)]


def _md5(seed: int, stream: str, key: str) -> str:
    return f"md5(concat('{seed}:{stream}:', {key}))"


def _number(key: str) -> str:
    return f"CAST(('0x' || substr({key}, 1, 8)) AS BIGINT)"


@query(
    """WITH c AS (SELECT * FROM (VALUES (1000000, 20, 20000), (1000000, NULL, 40000), (1000000, NULL, 240000), (10000, NULL, 40000), (50, NULL, 40000)) t(n, trees, cap)),
    r AS (SELECT CAST(n AS BIGINT) AS n, CAST(cap AS BIGINT) AS cap, CAST(trees AS BIGINT) AS trees, CAST(least(n, cap) AS BIGINT) AS rows_per_tree FROM c),
    t AS (SELECT n, cap, rows_per_tree, coalesce(trees, least(64, greatest(32, CAST(ceil(2000000 / rows_per_tree) AS BIGINT)))) AS n_trees FROM r)
    SELECT n, cap, rows_per_tree, n_trees, least(n, (63 * n_trees * rows_per_tree + 99) // 100) AS pool_rows FROM t"""
)
def planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, cap, (p := plan_fit(n, Config(n_trees=trees, bootstrap_max=cap))).rows_per_tree, p.n_trees, p.pool_rows) for n, trees, cap in _PLANS]
    return spark.createDataFrame(rows, "n long, cap long, rows_per_tree long, n_trees long, pool_rows long")


@query(
    """SELECT CAST(n AS BIGINT) AS n, n < 10000 AS regression, n < 40000 AS classification FROM (VALUES (100), (9999), (10000), (39999), (40000), (1000000)) t(n)"""
)
def replacement_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, resolve_replacement(None, n, False), resolve_replacement(None, n, True)) for n in (100, 9999, 10_000, 39_999, 40_000, 1_000_000)]
    return spark.createDataFrame(rows, "n long, regression boolean, classification boolean")


@query("""SELECT CAST(p AS BIGINT) AS p, CAST(greatest(1, floor(p * 0.9)) AS BIGINT) AS share, CAST(greatest(1, floor(sqrt(p))) AS BIGINT) AS root FROM (VALUES (1), (2), (5), (14), (130)) t(p)""")
def features_of_a_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p, features_per_node(0.9, p), features_per_node("sqrt", p)) for p in (1, 2, 5, 14, 130)]
    return spark.createDataFrame(rows, "p long, share long, root long")


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_md5(42, 'pool', 'o_orderkey')}, o_orderkey LIMIT 500")
def hash_sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), 500, 42, "pool", "o_orderkey")


@query(
    f"""WITH s AS (SELECT o_orderpriority FROM orders ORDER BY {_md5(42, 'targets', 'o_orderkey')}, o_orderkey LIMIT 1000)
    SELECT count(DISTINCT o_orderpriority) AS classes, greatest(1, count(DISTINCT o_orderpriority) - 1) AS outputs FROM s"""
)
def reservoir_class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = sample_rows(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), 1000, 42, "targets", "o_orderkey")
    classes = F.count_distinct("o_orderpriority")
    return some.agg(classes.alias("classes"), F.greatest(F.lit(1), classes - 1).alias("outputs"))


@query(f"SELECT o_orderkey FROM orders WHERE {_number(_md5(42, 'view', 'o_orderkey'))} < 429496729")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bernoulli(table(spark, sf_dir, "orders", "o_orderkey"), 0.1, 42, "view", "o_orderkey")


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM orders), d AS (SELECT CAST(i // 1000 AS INTEGER) AS tree_id, i % 1000 AS draw_id FROM range(3000) r(i))
    SELECT tree_id, {_number(_md5(7, 'bootstrap', "concat(tree_id, ':', draw_id)"))} % n AS idx, count(*) AS weight FROM d, n GROUP BY ALL"""
)
def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    return tree_draws(spark, 3, 1000, n, 7).groupBy("tree_id", "idx").agg(F.count("*").alias("weight"))


@query(
    f"""WITH t AS (SELECT CAST(tree_id AS INTEGER) AS tree_id, s_suppkey, {_md5(7, 'subsample', "concat(tree_id, ':', s_suppkey)")} AS h FROM supplier, range(4) r(tree_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY h, s_suppkey) AS pl FROM t)
    SELECT tree_id, s_suppkey AS idx FROM k WHERE pl <= 30"""
)
def subsample_per_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))
    return tree_samples(spark, pool, 4, 30, pool.count(), 7, replacement=False).select("tree_id", "idx")


@query(
    f"""WITH n AS (SELECT o_orderkey, o_custkey % 50 AS node, {_md5(3, 'window', "concat(o_custkey % 50, ':', o_orderkey)")} AS h FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY h, o_orderkey) AS pl FROM n)
    SELECT node, o_orderkey FROM k WHERE pl <= 40"""
)
def node_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("node"), "o_orderkey")
    order = Window.partitionBy("node").orderBy(hash_key(3, "window", "node", "o_orderkey"), "o_orderkey")
    return rows.withColumn("at", F.row_number().over(order)).filter("at <= 40").drop("at")


@query(
    f"""WITH f AS (SELECT DISTINCT c_custkey AS node, unnest(['a', 'b', 'c', 'd', 'e']) AS feature FROM customer),
    k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {_md5(3, 'features', "concat(node, ':', feature)")}) AS pl FROM f)
    SELECT node, feature FROM k WHERE pl <= 3"""
)
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).distinct()
    spread = nodes.withColumn("feature", F.explode(F.array(*map(F.lit, "abcde"))))
    order = Window.partitionBy("node").orderBy(hash_key(3, "features", "node", "feature"))
    return spread.withColumn("at", F.row_number().over(order)).filter("at <= 3").drop("at")


@query(
    f"""SELECT {_number(_md5(42, 'split', 'o_orderkey'))} < 3435973836 AS training, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"""
)
def split_hash_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = split(table(spark, sf_dir, "orders", "o_orderkey"), 0.8, 42, "o_orderkey")
    both = train.withColumn("training", F.lit(True)).unionByName(valid.withColumn("training", F.lit(False)))
    return both.groupBy("training").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query(
    """WITH w AS (SELECT *, dense_rank() OVER (ORDER BY date_trunc('week', o_orderdate) DESC) AS k FROM orders)
    SELECT k <= 12 AS validation, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM w GROUP BY 1"""
)
def split_last_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("week", F.date_trunc("week", "o_orderdate"))
    last = orders.select("week").distinct().orderBy(F.desc("week")).limit(12).withColumn("validation", F.lit(True))
    marked = orders.join(F.broadcast(last), "week", "left").withColumn("validation", F.coalesce("validation", F.lit(False)))
    return marked.groupBy("validation").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(
    f"""WITH a AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS pl FROM supplier),
    b AS (SELECT s_acctbal, s_nationkey, row_number() OVER (ORDER BY {_md5(5, 'permute', 's_suppkey')}, s_suppkey) AS pl FROM supplier)
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM a JOIN b USING (pl)"""
)
def permuted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuted(table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_nationkey", "s_acctbal"], "s_suppkey", 5, "permute")


@query(
    f"""WITH d AS (SELECT i AS draw, {_number(_md5(9, 'cut-row', 'i'))} % (SELECT count(*) FROM part) AS pl, CASE WHEN {_number(_md5(9, 'cut-feature', 'i'))} % 2 = 0 THEN 'p_size' ELSE 'p_retailprice' END AS feature
        FROM range((SELECT greatest(4, CAST(floor(count(*) * sqrt(2) / 10) AS BIGINT)) FROM part)) r(i)),
    p AS (SELECT p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS pl FROM part)
    SELECT DISTINCT feature, CASE WHEN feature = 'p_size' THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS cut FROM d JOIN p USING (pl)"""
)
def random_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    n = part.count()
    draws = spark.range(max(4, int(n * 2**0.5 / 10))).withColumnRenamed("id", "draw")
    draws = draws.withColumn("at", hash_number(hash_key(9, "cut-row", "draw")) % n).withColumn("feature", F.when(hash_number(hash_key(9, "cut-feature", "draw")) % 2 == 0, "p_size").otherwise("p_retailprice"))
    placed = part.withColumn("at", F.row_number().over(Window.orderBy("p_partkey")) - 1)
    cut = F.when(F.col("feature") == "p_size", F.col("p_size").cast("double")).otherwise(F.col("p_retailprice"))
    return draws.join(placed, "at").select("feature", cut.alias("cut")).dropDuplicates(["feature", "cut"])


@query(
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 1200 AS validation FROM orders)
    SELECT validation, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY 1"""
)
def split_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = split_final_rows(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), 1200, ["o_orderdate", "o_orderkey"])
    both = train.withColumn("validation", F.lit(False)).unionByName(valid.withColumn("validation", F.lit(True)))
    return both.groupBy("validation").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


@query("SELECT year(o_orderdate) = 1996 AND month(o_orderdate) = 12 AS validation, count(*) AS n FROM orders GROUP BY 1")
def split_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = (F.year("o_orderdate") == 1996) & (F.month("o_orderdate") == 12)
    return table(spark, sf_dir, "orders").groupBy(held.alias("validation")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def row_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return take_rows(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), keys, "l_orderkey")
