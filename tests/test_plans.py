"""Planning, parameters, sampling, formats."""

import math

import pytest
from pyspark.sql import functions as F

from arborlake.functions import sampling, scalars
from arborlake.plans.config import Config, features_per_node, plan_fit, resolve_replacement


def test_planner_goldens():
    p = lambda n, **c: (lambda x: (x.n_trees, x.rows_per_tree, x.pool_rows))(plan_fit(n, Config(**c)))
    assert p(1_000_000, n_trees=20, bootstrap_max=20_000) == (20, 20_000, 252_000)
    assert p(1_000_000)[0] == 50
    assert p(1_000_000, bootstrap_max=240_000)[0] == 32
    assert p(10_000)[0] == 64
    assert plan_fit(200, Config(n_trees=2, bootstrap_max=100)).pool_rows == 126
    assert plan_fit(1000, Config(oob=True)).rows_per_tree == 800
    assert plan_fit(1_000_000, Config(n_trees=20, bootstrap_max=20_000), outputs=2).rows_per_tree == 40_000
    assert resolve_replacement(None, 9_999, False) and not resolve_replacement(None, 10_000, False)
    assert resolve_replacement(None, 39_999, True) and not resolve_replacement(False, 5, True)
    assert (features_per_node(0.9, 5), features_per_node("sqrt", 130), features_per_node(0.1, 3)) == (4, 11, 1)


@pytest.mark.parametrize(
    "bad",
    [
        {"min_node_size": 1}, {"max_node_samples": 1}, {"bootstrap_max": 0}, {"bootstrap_fraction": 0}, {"bootstrap_fraction": 1.5, "replacement": False}, {"max_features": 0}, {"max_features": "log"},
        {"class_weight_power": 2}, {"cutoff_divisor": 0}, {"split_prior_rows": -1}, {"n_trees": 0}, {"split_prior_rows": math.nan},
    ],
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Config(**bad).checked()


def test_samples_are_exact_and_independent_of_layout(spark):
    df = spark.range(5000)
    one = {r.id for r in sampling.sample_rows(df, 300, 1, "s", "id").collect()}
    two = {r.id for r in sampling.sample_rows(df.repartition(13), 300, 1, "s", "id").collect()}
    assert one == two and len(one) == 300
    assert sampling.sample_rows(df, 9999, 1, "s", "id").count() == 5000
    assert sampling.sample_rows(df.limit(0), 5, 1, "s", "id").count() == 0
    indexed = sampling.dense_index(df, "id", 16)
    assert sorted(r.idx for r in indexed.collect()) == list(range(5000))
    drawn = sampling.tree_samples(spark, indexed, 3, 700, 5000, 1, replacement=False)
    assert {r["count"] for r in drawn.groupBy("tree_id").count().collect()} == {700}
    assert drawn.select("tree_id", "idx").distinct().count() == 2100
    again = sampling.tree_samples(spark, indexed, 3, 700, 5000, 1, replacement=True)
    assert again.count() == 2100 and again.select("tree_id", "idx").distinct().count() < 2100
    train, valid = sampling.split(df, 0.8, 3, "id")
    assert train.count() + valid.count() == 5000 and 3800 < train.count() < 4200


def test_dates(spark):
    df = spark.createDataFrame([("2023-12-31 23:59:58",), ("2024-02-29 00:00:00",), ("nothing",), (None,)], "d string")
    stamp = scalars.parse_date(F.col("d"), "%Y-%m-%d %H:%M:%S")
    rows = df.select(*(scalars.date_part(stamp, p).alias(p) for p in scalars.DATE_PARTS)).collect()
    assert list(rows[0]) == [2023, 12, 52, 31, 6, 365, 1, 0, 1, 0, 1, 0, 23, 59, 58, 1704067198]
    assert rows[1].Is_month_end == 1 and rows[1].Dayofyear == 60 and rows[2].Year is None and rows[3].Year is None
    assert scalars.date_part_names("eventDate")[0] == "eventYear" and scalars.date_part_names("day")[-1] == "dayElapsed"
    assert len(scalars.date_formats()) == 103
    short = spark.createDataFrame([("01/02/99",), ("1/2/05",)], "d string").select(F.year(scalars.parse_date(F.col("d"), "%m/%d/%y")))
    assert [r[0] for r in short.collect()] == [1999, 2005]
    assert spark.createDataFrame([("1850-01-01",)], "d string").select(scalars.parse_date(F.col("d"), "%Y-%m-%d")).first()[0] is None
    assert scalars.spark_pattern("%d.%m.%Y T%H") == "d.M.yyyy 'T'H"


def test_markers_and_numbers(spark):
    df = spark.createDataFrame([("",), ("NA",), ("3",), ("3.0",), ("true",), (None,), (" 1",), ("1d",), ("1e3",)], "v string")
    hit = lambda m: [r[0] for r in df.select(scalars.matches_marker(F.col("v"), m)).collect()]
    assert hit(None) == [True] + [False] * 8
    assert hit("NA").index(True) == 1 and hit(3)[2] and not hit(3)[3] and hit(3.0)[3] and hit(True)[4]
    assert [r[0] for r in df.select(scalars.parsed_number(F.col("v"))).collect()] == [None, None, 3.0, 3.0, None, None, None, None, 1000.0]
    assert scalars.common_prefix(["x2", "x3"]) == "x" and scalars.common_prefix(["a_1", "b_1"]) == ""
    assert scalars.significant(0.00012345, 4) == "1.234e-4" or scalars.significant(0.00012345, 4) == "1.235e-4"
