"""Level-wise growth of a tree on a table of any size: two jobs a level, whatever the number of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators import histogram as H


def grow_levels(rows: DataFrame, features: dict[str, Column], y: str, *, depth: int, prior: float = 3.0, min_node: int = 8) -> DataFrame:
    """(node, feature, kind, cut, n_left, n, score, gain) of the splits of one regression tree.

    Node ids are those of a heap: 2n + 1 left of n and 2n + 2 right. A level's splits come to the driver
    (2^level rows) and go out as a broadcast that moves every row to its child; no row is shuffled, only
    histograms are.
    """
    spark = rows.sparkSession
    at, levels = rows.withColumn("node", F.lit(0).cast("long")), []
    for level in range(depth):
        active = at.filter(F.col("node") >= 2**level - 1)
        hist = H.regression_histogram(H.long_form(active, features, ["node", y]), ["node"], y)
        splits = H.regression_splits(hist, ["node"], prior).filter(F.col("t_n") >= min_node)
        found = H.best(splits, ["node"]).select("node", "feature", "kind", "cut", F.col("l_n").cast("long").alias("n_left"), F.col("t_n").cast("long").alias("n"), F.round("score", 6).alias("score"), F.round("gain", 6).alias("gain"))
        known = spark.createDataFrame(found.collect(), found.schema)
        levels.append(known)
        at = H.route(at, known, features)
    return reduce(DataFrame.unionByName, levels)


def grow_class_levels(rows: DataFrame, features: dict[str, Column], label: str, *, depth: int, power: float = 0.75, min_node: int = 8) -> DataFrame:
    """As grow_levels for classes, whose weights are those of the whole table."""
    spark = rows.sparkSession
    at, levels = rows.withColumn("node", F.lit(0).cast("long")).withColumn("label", F.col(label)), []
    known_weights = H.class_weights(at, "label", power).select("label", "weight")
    weights = spark.createDataFrame(known_weights.collect(), known_weights.schema)
    for level in range(depth):
        active = at.filter(F.col("node") >= 2**level - 1)
        hist = H.class_histogram(H.long_form(active, features, ["node", "label"]), ["node"], "label")
        splits = H.class_splits(hist, ["node"], "label", weights).filter(F.col("t_n") >= min_node)
        found = H.best(splits, ["node"]).select("node", "feature", "kind", "cut", F.col("l_n").cast("long").alias("n_left"), F.col("t_n").cast("long").alias("n"), F.round("score", 6).alias("score"), F.round("gain", 6).alias("gain"))
        known = spark.createDataFrame(found.collect(), found.schema)
        levels.append(known)
        at = H.route(at, known, features)
    return reduce(DataFrame.unionByName, levels)
