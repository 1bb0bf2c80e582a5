"""Queries that grow small trees level by level, route rows through given forests, and add up what trees say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.sampling import hash_key, hash_number
from arborlake.operators.forest import Encoder, Feature, ForestModel
from arborlake.plans.config import Config
from arborlake.plans.queries_splits import _ORDERS, _ORDERS_LONG, _SHOWN, _WEIGHTS, FEATURES, best_sql, class_best_sql, lineitem_features
from arborlake.plans.registry import query, table

# tree, node, feature (-1: leaf), kind (0: <=, 1: <= with missing left, 2: =), cut, missing right, left child, rows, gain, depth, value
_NODES = [
    (0, 0, 0, 0, 25.0, True, 1, 100.0, 2.0, 0, 10.0), (0, 1, 1, 0, 0.05, True, 3, 60.0, 1.5, 1, 8.0), (0, 2, 2, 2, 0.02, True, 5, 40.0, 0.5, 1, 13.0),
    (0, 3, -1, 0, 0.0, True, -1, 30.0, 0.0, 2, 6.0), (0, 4, -1, 0, 0.0, True, -1, 30.0, 0.0, 2, 10.0), (0, 5, -1, 0, 0.0, True, -1, 10.0, 0.0, 2, 16.0), (0, 6, -1, 0, 0.0, True, -1, 30.0, 0.0, 2, 12.0),
    (1, 0, 2, 1, 0.03, False, 1, 100.0, 1.0, 0, 11.0), (1, 1, 0, 0, 10.0, True, 3, 50.0, 3.0, 1, 9.0), (1, 2, -1, 0, 0.0, True, -1, 50.0, 0.0, 1, 13.0),
    (1, 3, -1, 0, 0.0, True, -1, 20.0, 0.0, 2, 6.0), (1, 4, -1, 0, 0.0, True, -1, 30.0, 0.0, 2, 11.0),
    (2, 0, 1, 2, 0.07, True, 1, 100.0, 0.25, 0, 10.5), (2, 1, -1, 0, 0.0, True, -1, 10.0, 0.0, 1, 15.0), (2, 2, -1, 0, 0.0, True, -1, 90.0, 0.0, 1, 10.0),
]
_COLUMNS = ["l_quantity", "l_discount", "l_tax"]
_PROBS = {3: (0.7, 0.2, 0.1), 4: (0.4, 0.4, 0.2), 5: (0.1, 0.3, 0.6), 6: (0.2, 0.5, 0.3)}


def forest(spark: SparkSession, classes: list | None = None) -> ForestModel:
    """The given forest as a model; with classes, of its first tree."""
    names = ["tree_id", "node_id", "feature", "kind", "cut", "missing_right", "left_id", "n", "gain", "depth", "value"]
    nodes = pd.DataFrame([(*r[:-1], [r[-1]]) for r in _NODES], columns=names)
    if classes:
        nodes = nodes[nodes["tree_id"] == 0].copy()
        nodes["value"] = [list(_PROBS.get(i, (0.4, 0.35, 0.25))) for i in nodes["node_id"]]
    nodes.insert(0, "config_id", 0)
    encoder = Encoder(_COLUMNS, [Feature(c, "numeric", [c]) for c in _COLUMNS], {c: {"all_int": c == "l_quantity"} for c in _COLUMNS}, {}, {}, True)
    return ForestModel(spark, Config(), encoder, nodes, classes, "y")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a key, the forest's features (a tax of 4 % is missing), and the target."""
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.expr("nullif(l_tax, 0.04) AS l_tax"), "l_extendedprice")


_VALUES = ", ".join(f"({t}, {i}, {f}, {k}, {c}, {str(m).lower()}, {left}, {n}, {g}, {d}, {v})" for t, i, f, k, c, m, left, n, g, d, v in _NODES)
_NODE_SQL = f"nodes AS (SELECT * FROM (VALUES {_VALUES}) t(tree_id, node_id, feature, kind, cut, missing_right, left_id, n, gain, depth, value))"
#: Every row's way through every tree, a step a level: at holds the node, before its parent's value.
ROUTED = f"""{_NODE_SQL},
    base AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, nullif(l_tax, 0.04) AS l_tax, l_extendedprice FROM lineitem),
    way AS (SELECT b.*, n.tree_id, n.node_id AS pl, CAST(NULL AS INTEGER) AS by_feature, CAST(0.0 AS DOUBLE) AS change, n.feature AS f, n.value AS v FROM base b, nodes n WHERE n.node_id = 0
        UNION ALL
        SELECT w.l_orderkey, w.l_linenumber, w.l_quantity, w.l_discount, w.l_tax, w.l_extendedprice, w.tree_id, c.node_id, n.feature, CAST(c.value - n.value AS DOUBLE), c.feature, c.value
        FROM way w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.pl
        JOIN nodes c ON c.tree_id = w.tree_id AND c.node_id = n.left_id + CASE
            WHEN (CASE n.feature WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) IS NULL THEN CAST(n.missing_right AS INTEGER)
            WHEN n.kind = 2 THEN CAST((CASE n.feature WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) <> n.cut AS INTEGER)
            ELSE CAST((CASE n.feature WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END) > n.cut AS INTEGER) END
        WHERE n.feature >= 0),
    leaf AS (SELECT * FROM way WHERE f < 0)"""


@query(f"WITH RECURSIVE {ROUTED} SELECT CAST(tree_id AS INTEGER) AS tree_id, CAST(pl AS BIGINT) AS node, count(*) AS n FROM leaf GROUP BY 1, 2")
def tree_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level by level with broadcast joins, all trees at once."""
    nodes = forest(spark)._nodes()
    at = rows(spark, sf_dir).withColumn("tree_id", F.explode(F.array(*(F.lit(t) for t in range(3))))).withColumn("node", F.lit(0).cast("long"))
    value = F.when(F.col("feature") == 0, F.col("l_quantity")).when(F.col("feature") == 1, F.col("l_discount")).otherwise(F.col("l_tax"))
    for _ in range(nodes.agg(F.max("depth")).first()[0]):
        step = nodes.filter("feature >= 0").select("tree_id", F.col("node_id").alias("node"), "feature", "kind", "cut", "missing_right", "left_id")
        right = F.when(value.isNull(), F.col("missing_right")).when(F.col("kind") == 2, value != F.col("cut")).otherwise(value > F.col("cut"))
        moved = at.join(F.broadcast(step), ["tree_id", "node"], "left")
        at = moved.withColumn("node", F.when(F.col("left_id").isNull(), F.col("node")).otherwise(F.col("left_id") + right.cast("int"))).select(*at.columns)
    return at.groupBy("tree_id", "node").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {ROUTED} SELECT l_orderkey, l_linenumber, CAST(v AS DOUBLE) AS prediction FROM leaf WHERE tree_id = 0")
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).predict_trees(rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.col("trees")[0].alias("prediction"))


@query(f"WITH RECURSIVE {ROUTED} SELECT l_orderkey, l_linenumber, round(CAST(CAST(sum(v) / 3 AS FLOAT) AS DOUBLE), 4) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_discount, l_tax) AS copy FROM leaf) GROUP BY l_orderkey, l_linenumber, copy")
def forest_predict_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).transform(rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.round(F.col("prediction").cast("double"), 4).alias("prediction"))


@query(f"WITH RECURSIVE {ROUTED} SELECT l_orderkey, l_linenumber, CAST(tree_id AS INTEGER) AS tree_id, CAST(v AS DOUBLE) AS prediction FROM leaf")
def predict_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).predict_trees(rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.posexplode("trees").alias("tree_id", "prediction"))


@query(f"WITH RECURSIVE {ROUTED} SELECT l_orderkey, l_linenumber, round(stddev_pop(v), 6) AS std FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_discount, l_tax) AS copy FROM leaf) GROUP BY l_orderkey, l_linenumber, copy")
def predict_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).predict_std(rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.round("std", 6).alias("std"))


_PROBS_SQL = "probs AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {a}, {b}, {c})" for n, (a, b, c) in _PROBS.items()) + ") t(node, p_A, p_N, p_R))"


@query(f"WITH RECURSIVE {ROUTED}, {_PROBS_SQL} SELECT l_orderkey, l_linenumber, CAST(p_A AS DOUBLE) AS proba_A, CAST(p_N AS DOUBLE) AS proba_N, CAST(p_R AS DOUBLE) AS proba_R FROM leaf JOIN probs ON pl = node WHERE tree_id = 0")
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, ["A", "N", "R"]).transform(rows(spark, sf_dir), proba=True).select("l_orderkey", "l_linenumber", "proba_A", "proba_N", "proba_R")


@query(f"WITH RECURSIVE {ROUTED} SELECT l_orderkey, l_linenumber, CASE pl WHEN 3 THEN 'A' WHEN 4 THEN 'A' WHEN 5 THEN 'R' ELSE 'N' END AS prediction FROM leaf WHERE tree_id = 0")
def predict_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, ["A", "N", "R"]).transform(rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", "prediction")


@query(
    f"""WITH RECURSIVE {ROUTED}, c AS (SELECT by_feature, l_quantity, count(*) AS steps, sum(change) / 3 AS total FROM way WHERE by_feature IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT f AS by_feature, l_quantity FROM (SELECT unnest([0, 1, 2]) AS f), (SELECT DISTINCT l_quantity FROM lineitem))
    SELECT CASE g.by_feature WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' ELSE 'l_tax' END AS feature, g.l_quantity, round(coalesce(total, 0.0), 4) AS contribution FROM g LEFT JOIN c ON g.by_feature = c.by_feature AND g.l_quantity = c.l_quantity"""
)
def explain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark).explain(rows(spark, sf_dir).withColumn("key", F.col("l_quantity")), "key")
    return found.groupBy("feature", F.col("key").alias("l_quantity")).agg(F.round(F.sum("contribution"), 4).alias("contribution"))


@query(
    f"""WITH RECURSIVE {ROUTED}, p AS (SELECT l_orderkey, l_linenumber, copy, sum(v) / 3 AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_discount, l_tax) AS copy FROM leaf) GROUP BY 1, 2, 3)
    SELECT round(31.5 / 3, 6) AS bias, count(*) AS n, round(avg(prediction), 6) AS prediction FROM p"""
)
def explain_adds_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest(spark).explain(rows(spark, sf_dir).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber")), "key")
    one = found.filter("feature = 'l_tax'")
    return one.agg(F.round(F.max("bias"), 6).alias("bias"), F.count("*").alias("n"), F.round(F.avg("prediction"), 6).alias("prediction"))


@query(f"WITH {_NODE_SQL} SELECT CAST(tree_id AS INTEGER) AS tree_id, count(*) AS nodes, count(*) FILTER (feature < 0) AS leaves, CAST(max(depth) AS INTEGER) AS depth FROM nodes GROUP BY 1")
def tree_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = forest(spark)._nodes()
    return nodes.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("feature") < 0).alias("leaves"), F.max("depth").alias("depth"))


@query(f"WITH {_NODE_SQL} SELECT CAST(feature AS INTEGER) AS feature, CAST(depth AS INTEGER) AS depth, count(*) AS splits, count(*) FILTER (kind = 2) AS equality FROM nodes WHERE feature >= 0 GROUP BY 1, 2")
def split_counts_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).split_counts_by_depth()


@query(f"WITH {_NODE_SQL} SELECT CASE feature WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' ELSE 'l_tax' END AS feature, round(CAST(sum(gain * n) / (SELECT sum(gain * n) FROM nodes WHERE feature >= 0) AS DOUBLE), 6) AS importance FROM nodes WHERE feature >= 0 GROUP BY 1")
def split_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark).split_importance().withColumn("importance", F.round("importance", 6))


def _oob_parts(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    """(o_orderkey, mean, n): what three trees' means say of the orders outside their samples of 70 %."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_custkey")
    spread = orders.withColumn("tree_id", F.explode(F.array(*(F.lit(t) for t in range(3)))))
    bag = spread.withColumn("inside", hash_number(hash_key(seed, "bag", "tree_id", "o_orderkey")) < int(0.7 * 2**32))
    said = bag.filter("inside").groupBy("tree_id", "o_orderpriority").agg(F.avg(F.col("o_custkey") % 100).alias("p"))
    outside = bag.filter("NOT inside").join(F.broadcast(said), ["tree_id", "o_orderpriority"])
    return outside.groupBy("o_orderkey").agg(F.avg("p").alias("mean"), F.count("*").alias("n"))


def _oob_sql(seed: int) -> str:
    number = f"CAST(('0x' || substr(md5(concat('{seed}:bag:', tree_id, ':', o_orderkey)), 1, 8)) AS BIGINT)"
    return f"""(WITH bag AS (SELECT *, {number} < {int(0.7 * 2**32)} AS inside FROM orders, range(3) r(tree_id)),
        said AS (SELECT tree_id, o_orderpriority, avg(o_custkey % 100) AS p FROM bag WHERE inside GROUP BY 1, 2)
        SELECT o_orderkey, avg(p) AS mean, count(*) AS n FROM bag JOIN said USING (tree_id, o_orderpriority) WHERE NOT inside GROUP BY 1)"""


@query(f"SELECT o_orderkey, round(mean, 6) AS mean, n FROM {_oob_sql(11)}")
def oob_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oob_parts(spark, sf_dir, 11).select("o_orderkey", F.round("mean", 6).alias("mean"), "n")


@query(f"SELECT o_orderkey, round(sum(mean * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {_oob_sql(11)} UNION ALL SELECT * FROM {_oob_sql(12)}) GROUP BY 1")
def combine_oob(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _oob_parts(spark, sf_dir, 11).unionByName(_oob_parts(spark, sf_dir, 12))
    return both.groupBy("o_orderkey").agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


def _again(ctes: str) -> str:
    """The CTEs of a level under other names."""
    for name in ("long", "own", "grid", "hist", "run", "cand", "sums", "scored", "best"):
        ctes = ctes.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)").replace(f"FROM {name},", f"FROM {name}2,").replace(f"JOIN {name} ", f"JOIN {name}2 ").replace(f"{name}.", f"{name}2.")
    return ctes


def _grown_sql() -> str:
    """A tree of depth 2: the root's split, then both children's."""
    first = best_sql(" UNION ALL ".join(f"SELECT CAST(0 AS BIGINT) AS node, l_quantity AS y, '{n}' AS feature, CAST({s} AS DOUBLE) AS value FROM lineitem" for n, (s, _) in FEATURES.items()), "node")
    value = "CASE feature " + " ".join(f"WHEN '{n}' THEN CAST({s} AS DOUBLE)" for n, (s, _) in FEATURES.items()) + " END"
    node = f"CASE WHEN ({value}) IS NULL THEN (CASE WHEN kind = 'le_missing_left' THEN 1 ELSE 2 END) WHEN kind = 'eq' THEN (CASE WHEN ({value}) = cut THEN 1 ELSE 2 END) WHEN ({value}) <= cut THEN 1 ELSE 2 END"
    second = best_sql(" UNION ALL ".join(f"SELECT node, l_quantity AS y, '{n}' AS feature, CAST({s} AS DOUBLE) AS value FROM moved" for n, (s, _) in FEATURES.items()), "node")
    second = _again(second)
    return f"WITH {first}, moved AS (SELECT l.*, CAST({node} AS BIGINT) AS node FROM lineitem l, (SELECT feature, kind, cut FROM best)), {second} SELECT node, {_SHOWN} FROM best UNION ALL SELECT node, {_SHOWN} FROM best2"


@query(_grown_sql())
def tree_depth2_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-wise growth: each level is one histogram of all its nodes and a broadcast of its splits."""
    from arborlake.operators.grow import grow_levels

    return grow_levels(table(spark, sf_dir, "lineitem"), lineitem_features(), "l_quantity", depth=2)


def _grown_class_sql() -> str:
    value = "CASE feature " + " ".join(f"WHEN '{n}' THEN CAST({q} AS DOUBLE)" for n, (q, _) in _ORDERS.items()) + " END"
    node = f"CASE WHEN kind = 'eq' THEN (CASE WHEN ({value}) = cut THEN 1 ELSE 2 END) WHEN ({value}) <= cut THEN 1 ELSE 2 END"
    long = " UNION ALL ".join(f"SELECT node, o_orderstatus AS label, '{n}' AS feature, CAST({q} AS DOUBLE) AS value FROM moved" for n, (q, _) in _ORDERS.items())
    moved = f"moved AS (SELECT o.*, CAST({node} AS BIGINT) AS node FROM orders o, (SELECT feature, kind, cut FROM best))"
    return f"WITH {_WEIGHTS}, {class_best_sql(_ORDERS_LONG)}, {moved}, {_again(class_best_sql(long))} SELECT node, {_SHOWN} FROM best UNION ALL SELECT node, {_SHOWN} FROM best2"


@query(_grown_class_sql())
def tree_depth2_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.operators.grow import grow_class_levels

    return grow_class_levels(table(spark, sf_dir, "orders"), {n: c() for n, (_, c) in _ORDERS.items()}, "o_orderstatus", depth=2)
