"""Whole fits on invented shops, parcels and sensors: quality, layout, missing values, texts, dates, bundles, storage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions.metrics import accuracy, r2
from arborlake.functions.sampling import sample_rows
from arborlake.operators import analysis, auto, encode
from arborlake.operators.forest import ForestClassifier, ForestModel, ForestRegressor, oob_score
from arborlake.plans.config import Config

TOWNS = ["Aarau", "Bern", "Chur", "Davos", "Ennetbürgen", "Flims", "Glarus"]
RENT = {t: 90.0 * i for i, t in enumerate(TOWNS)}


@pytest.fixture(scope="module")
def flats(spark):
    """Rent follows from area, town and floor; noise does not help; one column repeats another's information."""
    rng = random.Random(5)
    rows = []
    for i in range(420):
        area, town, floor = rng.uniform(25, 140), rng.choice(TOWNS), rng.randint(0, 6)
        rows.append((f"flat-{i:03}", area, town, floor, rng.random(), 11.0 * area + RENT[town] + 15 * floor))
    return spark.createDataFrame(rows, "flat string, area double, town string, floor int, noise double, rent double").cache()


@pytest.fixture(scope="module")
def model(flats):
    return ForestRegressor(n_trees=18, seed=7, oob=True).fit(flats, "rent", key="flat")


def test_rents_are_learned_on_any_layout(flats, model):
    scored = model.transform(flats)
    assert scored.agg(r2("rent", "prediction")).first()[0] > 0.9 and oob_score(model) > 0.8
    again = ForestRegressor(n_trees=18, seed=7, oob=True).fit(flats.repartition(9, "floor"), "rent", key="flat")
    same = ["tree_id", "node_id", "feature", "cut", "n", "gain"]
    assert model.nodes[same].sort_values(same[:2]).reset_index(drop=True).equals(again.nodes[same].sort_values(same[:2]).reset_index(drop=True))
    other = ForestRegressor(n_trees=18, seed=8).fit(flats, "rent", key="flat")
    assert other.nodes["cut"].tolist() != model.nodes["cut"].tolist()


def test_seeds_that_end_alike_grow_different_trees(flats):
    nodes = [ForestRegressor(n_trees=2, seed=s, max_features=0.5, replacement=False).fit(flats, "rent", key="flat").nodes for s in (1_234_567_890, 2_234_567_890)]
    assert nodes[0]["feature"].tolist() != nodes[1]["feature"].tolist() or nodes[0]["cut"].tolist() != nodes[1]["cut"].tolist()


def test_trees_spread_and_explanations_agree_with_the_prediction(flats, model):
    rows = {r.flat: r for r in model.predict_std(model.predict_trees(model.transform(flats)).withColumnRenamed("trees", "each")).collect()}
    for r in list(rows.values())[:60]:
        assert len(r.each) == 18 and abs(np.mean(r.each) - r.prediction) < 0.01 and abs(np.std(r.each) - r["std"]) < 1e-6
    told = model.explain(flats, "flat").groupBy("flat").agg((F.first("bias") + F.sum("contribution")).alias("sum")).collect()
    assert all(abs(r["sum"] - rows[r.flat].prediction) < 0.01 for r in told)


def test_structure_and_importances(model):
    assert (model.tree_leaf_counts_ * 2 == model.tree_node_counts_ + 1).all() and model.tree_depths_.min() >= 2
    share = dict(zip(model.feature_names_in_, model.feature_importances_, strict=True))
    assert abs(sum(share.values()) - 1) < 1e-9 and max(share, key=share.get) == "area" and share["noise"] < share["town"]
    counts = model.split_counts_by_depth()
    assert counts.agg(F.sum("splits")).first()[0] == (model.nodes["feature"] >= 0).sum() and counts.filter("equality > splits").count() == 0


def test_saved_models_predict_alike_and_damage_is_noticed(spark, flats, model, tmp_path):
    model.save(f"{tmp_path}/model")
    back = ForestModel.load(spark, f"{tmp_path}/model")
    want = {r.flat: r.prediction for r in model.transform(flats).collect()}
    assert {r.flat: r.prediction for r in back.transform(flats).collect()} == want
    twice = model.combined(back)
    assert twice.n_trees_ == 36 and all(abs(r.prediction - want[r.flat]) < 0.01 for r in twice.transform(flats).collect())
    nodes = spark.read.parquet(f"{tmp_path}/model/nodes").withColumn("feature", F.lit(99))
    nodes.write.parquet(f"{tmp_path}/bad/nodes")
    spark.read.parquet(f"{tmp_path}/model/metadata").write.parquet(f"{tmp_path}/bad/metadata")
    with pytest.raises(ValueError, match="invalid node"):
        ForestModel.load(spark, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="different encoders"):
        model.combined(ForestRegressor(n_trees=1, seed=7).fit(flats.filter("town <> 'Bern'"), "rent", key="flat"))


def test_analysis_names_what_matters(flats, model):
    found = {r.feature: r.importance for r in analysis.permutation_importance(model, flats, "rent", "flat", n_repeats=2).collect()}
    assert found["area"] > found["town"] > found["noise"]
    train, valid = flats.filter("floor <= 4"), flats.filter("floor > 4")
    lost = {r.feature: r.importance for r in analysis.drop_column_importance(ForestRegressor(n_trees=6, seed=2), train, valid, "rent", "flat", ["area", "noise"]).collect()}
    assert lost["area"] > lost["noise"]
    curve = [r.average for r in analysis.partial_dependence(model, flats, "flat", "area", grid_points=6, n_samples=80).orderBy("area").collect()]
    assert len(curve) == 6 and curve == sorted(curve)
    assert analysis.partial_dependence(model, flats, "flat", ["area", "floor"], grid_points=4, n_samples=40).count() == 4 * 7
    each = analysis.partial_dependence(model, flats, "flat", "area", grid_points=6, n_samples=30, individual=True)
    wide = each.groupBy("flat").pivot("area").agg(F.first("prediction")).drop("flat").toPandas().to_numpy()
    assert analysis.clustered_ice(wide, 2).shape == (2, 6)


def test_dependence_ranks_texts_and_refuses_too_little(flats):
    doubled = flats.withColumn("district", F.concat(F.lit("district of "), "town"))
    relations = analysis.feature_relations(flats.withColumn("feet", F.col("area") * 10.76), ["area", "floor", "feet"], "flat")
    assert ("area", "feet") in analysis.related_groups(relations, 0.05)
    found = {r.target: r.predictability for r in analysis.feature_dependence(doubled, ["town", "district", "noise"], "flat", n_samples=None, n_trees=4).collect()}
    assert found["district"] > 0.9 and found["town"] > 0.9 and found["noise"] < 0.5
    with pytest.raises(ValueError, match="two features"):
        analysis.feature_dependence(flats, ["town"], "flat")
    with pytest.raises(ValueError, match="five rows"):
        analysis.feature_dependence(flats.limit(4), ["town", "area"], "flat")


@pytest.fixture(scope="module")
def parcels(spark):
    rng = random.Random(9)
    rows = []
    for i in range(700):
        weight, fragile, zone = rng.uniform(0, 30), rng.random() < 0.3, rng.randint(1, 4)
        rows.append((i, weight, int(fragile), zone, "by hand" if fragile else "pallet" if weight > 18 else f"belt {1 + zone % 2}"))
    return spark.createDataFrame(rows, "id int, weight double, fragile int, zone int, route string")


def test_classes_and_their_probabilities(parcels):
    model = ForestClassifier(n_trees=16, seed=3, oob=True).fit(parcels, "route", key="id")
    assert model.classes_ == ["belt 1", "belt 2", "by hand", "pallet"] and oob_score(model) > 0.9
    assert model.transform(parcels).agg(accuracy("route", "prediction")).first()[0] > 0.97
    shares = model.transform(parcels, proba=True).select(*(f"`proba_{c}`" for c in model.classes_)).collect()
    assert all(abs(sum(r) - 1) < 1e-9 and min(r) >= 0 for r in shares)


@pytest.mark.parametrize("change, message", [("'belt 1'", "at least two classes"), ("CASE WHEN id % 50 > 0 THEN route END", "cannot be missing")])
def test_labels_that_cannot_be_learned(parcels, change, message):
    with pytest.raises(ValueError, match=message):
        ForestClassifier().fit(parcels.withColumn("route", F.expr(change)), "route", key="id")


def test_typed_markers_unseen_texts_and_new_missing_values(spark, flats):
    """Area is written as text with a marker for what was not measured."""
    written = flats.withColumn("area", F.when(F.col("floor") == 6, "n/m").otherwise(F.round("area", 1).cast("string"))).withColumn("unused", F.lit("-"))
    settings = {"n_trees": 6, "seed": 4, "missing_values": {"area": "n/m"}, "date_columns": {}}
    model = ForestRegressor(**settings).fit(written, "rent", key="flat")
    assert {c: model.encoder.profile[c]["kind"] for c in written.columns[1:5]} == {"area": "numeric", "town": "lexical", "floor": "numeric", "noise": "numeric"}
    assert model.encoder.profile["unused"]["kind"] == "discarded" and model.encoder.profile["floor"]["all_int"]
    new = spark.createDataFrame([("77.5", "Zug", 2, 0.5, "x"), ("n/m", "Aaaa", 9, 0.1, None)], "area string, town string, floor int, noise double, unused string")
    assert all(np.isfinite(r.prediction) for r in model.transform(new).collect())
    nowhere = new.withColumn("town", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="had none during training"):
        model.transform(nowhere).collect()
    assert all(np.isfinite(r.prediction) for r in ForestRegressor(**settings, allow_new_missing=True).fit(written, "rent", key="flat").transform(nowhere).collect())


def test_a_broken_sensor_is_a_signal(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 50), 100.0 if i % 5 == 0 else float(i % 50 > 25)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, reading double, alarm double")
    model = ForestRegressor(n_trees=6, seed=6).fit(df, "alarm", key="id")
    got = [r.prediction for r in model.transform(spark.createDataFrame([(None,), (3.0,), (44.0,)], "reading double")).collect()]
    assert got[0] > 90 and got[1] < 5 and got[2] < 5


def test_dates_become_parts(spark):
    days = [("03.02.2021", 20210203), ("17.08.2021", 20210817), ("28.11.2022", 20221128), ("01.05.2023", 20230501), ("30.09.2023", 20230930)]
    df = spark.createDataFrame([(i, days[i % 5][0].replace(".", "/"), days[i % 5][1], float(int(days[i % 5][0][3:5]))) for i in range(150)], "id int, shipDate string, bookedDate int, month double")
    model = ForestRegressor(n_trees=5, seed=2, max_features=1.0).fit(df, "month", key="id")
    assert model.encoder.date_columns == {"shipDate": "%d/%m/%Y", "bookedDate": "%Y%m%d"}
    assert {"shipMonth", "bookedDay"} <= set(model.encoded_names) and model.transform(df).agg(r2("month", "prediction")).first()[0] > 0.9
    assert np.isfinite(model.transform(spark.createDataFrame([("soon", 7)], "shipDate string, bookedDate int")).first().prediction)


def test_flags_that_exclude_each_other_are_one_feature(spark):
    colours = ["red", "blue", "green", "grey"]
    rows = [(i, float(i * 37 % 23), *(int(i % 4 == j) for j in range(4)), colours[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, size double, is_red int, is_blue int, is_green int, is_grey int, colour string")
    model = ForestClassifier(n_trees=5, seed=2, max_features=1.0).fit(df, "colour", key="id")
    bundle = next(f for f in model.encoder.features if f.kind == "bundle")
    assert set(bundle.sources) == {"is_red", "is_blue", "is_green", "is_grey"} and model.transform(df).agg(accuracy("colour", "prediction")).first()[0] == 1
    grid = {r[0] for r in analysis.partial_dependence(model, df, "id", bundle.name, n_samples=20).select(bundle.name).collect()}
    assert grid == {"(none)", *bundle.sources}
    rare = spark.createDataFrame([(int(i % 20 == 3), int(i % 20 == 4)) for i in range(200)], "first int, second int")
    assert encode.bundles(rare, ["first", "second"]) == []
    with pytest.raises(Exception, match="neither 0 nor 1"):
        model.transform(df.withColumn("is_red", F.lit(2))).collect()


def test_a_split_by_equality_needs_one_node(spark):
    df = spark.createDataFrame([(i, float(i % 6), 50.0 if i % 6 == 3 else -1.0) for i in range(180)], "id int, code double, y double")
    model = ForestRegressor(n_trees=1, seed=1, replacement=False, max_features=1.0).fit(df, "y", key="id")
    assert len(model.nodes) == 3 and model.transform(df).filter("prediction <> y").count() == 0


@pytest.mark.parametrize("change, message", [(("rent", "CASE WHEN floor > 0 THEN rent END"), "finite"), (("area", "array(area)"), "unsupported column type")])
def test_columns_that_cannot_be_used(flats, change, message):
    with pytest.raises(ValueError, match=message):
        ForestRegressor(n_trees=1).fit(flats.withColumn(change[0], F.expr(change[1])), "rent", key="flat")


def test_an_empty_table_cannot_be_fitted(flats):
    with pytest.raises(ValueError, match="at least one row"):
        ForestRegressor(n_trees=1).fit(flats.filter("area < 0"), "rent", key="flat")


def test_samples_have_their_exact_size(spark):
    df = spark.createDataFrame([(i % 70 if i < 140 else i,) for i in range(900)] + [(None,)] * 30, "k long")
    for k in (0, 1, 17, 400, 929, 930, 5000):
        got = [r.k for r in sample_rows(df, k, 3, "s", "k").collect()]
        assert len(got) == min(k, 930)
        assert sorted(map(str, got)) == sorted(str(r.k) for r in sample_rows(df.repartition(7), k, 3, "s", "k").collect())
    assert sample_rows(df.limit(0), 5, 3, "s", "k").count() == 0


def test_levels_are_taken_while_they_pay():
    assert auto.justified([2.0, 1.97, 1.93, 1.9]) == 3 and auto.justified([2.0, 1.999, 1.97]) == 1 and auto.justified([2.0, 2.5, 3.0]) == 0 and auto.justified([0.0, 1.0]) == 0


def test_sweeps_share_a_pool_and_give_the_fits_of_their_own(flats):
    suite = auto.forest_suite(Config(seed=1), {"max_features": [0.9, 0.4], "min_node_size": [30]})
    assert [s.name for s in suite] == ["defaults", "max_features=0.4", "min_node_size=30"]
    screened = {r["name"]: r for r in auto.screen(ForestRegressor(seed=1), flats, "rent", suite, key="flat").collect()}
    assert screened["defaults"].relative == 1 and screened["min_node_size=30"].nodes < screened["defaults"].nodes
    with pytest.raises(ValueError, match="out-of-bag"):
        auto.screen(ForestRegressor(), flats, "rent", [auto.Sweep("all", {}, Config(bootstrap_fraction=1.0, replacement=False))])
    pair = ForestRegressor(seed=1).fit_many(flats, "rent", {"a": Config(seed=1, n_trees=2), "b": Config(seed=1, n_trees=2, min_node_size=30)}, key="flat")
    assert pair["b"].nodes["cut"].tolist() == ForestRegressor(seed=1, n_trees=2, min_node_size=30).fit(flats, "rent", key="flat").nodes["cut"].tolist()


def words_and_values(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(900)]
    return spark.createDataFrame([(i, w, float(ord(w[0]) * 3 + ord(w[1]))) for i, w in enumerate(words)], "id int, word string, value double")


def test_a_grown_forest_is_its_batches(spark):
    """With a text column, whose cuts mean something in one dictionary only."""
    df = words_and_values(spark)
    grown = auto.AutoForest(autogrow=True, tree_batch_size=3, max_trees=9, min_improvement=0.0, seed=5)
    model = grown.fit(df, "value", key="id")
    assert [h["trees"] for h in grown.tree_history_] == list(range(3, 3 * len(grown.tree_history_) + 1, 3)) and grown.tree_history_[0] == {"trees": 3, "loss": grown.tree_history_[0]["loss"], "improvement": None, "accepted": True}
    step = Config(n_trees=3, oob=True, seed=5, max_features=0.9)
    pool = ForestRegressor(seed=5).pool(df, "value", [step], key="id")
    tracked = pool.tracking(auto.TRACKED, 5)
    whole, batches = None, len(grown.tree_history_) - (not grown.tree_history_[-1]["accepted"])
    for b in range(batches):
        part = pool.grown(step.but(seed=auto.batch_seed(5, b) if b else 5), tracked)
        whole = part if whole is None else whole.combined(part)
    assert whole.encoder.to_json() == model.encoder.to_json() and whole.nodes["cut"].tolist() == model.nodes["cut"].tolist()
    assert abs(auto.loss(whole) - [h["loss"] for h in grown.tree_history_ if h["accepted"]][-1]) < 1e-9
    outside = {r.row_id: r for r in whole.oob_.collect()}
    assert len(outside) <= pool.size and all(0 < r["count"] <= 3 * batches for r in outside.values())
    pool.release()
    assert model.transform(df).agg(r2("value", "prediction")).first()[0] > 0.9


def test_growth_stops_where_a_batch_pays_too_little(spark):
    df = words_and_values(spark)
    for keep in (False, True):
        grown = auto.AutoForest(autogrow=True, tree_batch_size=2, max_trees=40, min_improvement=0.9, keep_last_batch=keep, seed=5)
        assert grown.fit(df, "value", key="id").n_trees_ == (4 if keep else 2)
        first, last = grown.tree_history_
        assert not last["accepted"] and abs(last["improvement"] - (first["loss"] - last["loss"]) / first["loss"]) < 1e-12


def _windows(node):
    """(window, whether an aggregate is below it) for all windows of a plan that are not partitioned."""
    below = [node.children().apply(i) for i in range(node.children().size())]
    inner = [x for b in below for x in _windows(b)]
    if node.nodeName() == "Window" and not node.partitionSpec().size():
        return [(node, "Aggregate" in node.toString()), *inner]
    return inner


@pytest.mark.parametrize("few", [500_000, 0])
def test_ranks_are_of_distinct_values_in_ranges(spark, few, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(analysis, "FEW_VALUES", few, raising=False)
    monkeypatch.setattr(analysis, "RANGES", 5, raising=False)
    rng = random.Random(3)
    rows = [(rng.choice([None, 7.5, -0.0, 0.0, float("nan"), rng.uniform(-9, 9)]), rng.choice(TOWNS), rng.randint(0, 400), 7) for _ in range(3000)]
    toll = spark.createDataFrame(rows, "weight double, town string, axles int, lane int").repartition(6)
    names = toll.columns
    ranked = analysis.average_ranks(toll, names)
    found = sorted(tuple(r) for r in ranked.collect())

    def ranks(values, order):
        return pd.Series([order(v) for v in values]).rank(method="average").sub(1).tolist()

    columns = list(zip(*rows, strict=True))
    weight = ranks(columns[0], lambda v: -1e9 if v is None else 1e9 if v != v else v + 0.0)
    want = [weight, ranks(columns[1], TOWNS.index), ranks(columns[2], int), ranks(columns[3], int)]
    assert found == sorted(zip(*want, strict=True))
    matrix = {(r.a, r.b): r.correlation for r in analysis.spearman(toll, names).collect()}
    assert len(matrix) == 16 and all(matrix[c, "lane"] == (c == "lane") for c in names)
    assert matrix["axles", "weight"] == matrix["weight", "axles"] == pytest.approx(np.corrcoef(want[0], want[2])[0, 1], abs=1e-9)
    assert all(counted for _, counted in _windows(ranked._jdf.queryExecution().optimizedPlan()))


def test_ranks_of_no_rows_and_of_instants(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert {r.correlation for r in analysis.spearman(empty, ["a", "b"]).filter("a != b").collect()} == {0.0}
    times = spark.sql("SELECT timestamp'2024-10-27 00:30:00' + make_interval(0, 0, 0, 0, 0, CAST(id % 90 AS INT)) AS at, id % 90 AS n FROM range(900)")
    assert all(r["at"] == r["n"] for r in analysis.average_ranks(times, ["at", "n"]).collect())


def test_a_pool_has_few_tasks_and_looks_for_its_tracked_rows_once(spark, flats):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        config = Config(n_trees=4, seed=7, oob=True)
        pool = ForestRegressor().pool(flats, "rent", [config], key="flat")
        assert pool.indexed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert pool.tracking(50, 7) is pool.tracking(50, 7) and pool.tracking(50, 7).count() == 50
        one, two = pool.grown(config), pool.grown(config, pool.tracking(50, 7))
        assert {r.row_id for r in two.oob_.collect()} < {r.row_id for r in one.oob_.collect()} and one.nodes["cut"].equals(two.nodes["cut"])
        pool.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
