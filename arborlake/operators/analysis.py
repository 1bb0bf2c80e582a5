"""Importances, partial dependence, rank correlations, clusters and dependence of features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from arborlake.functions.metrics import METRICS
from arborlake.functions.sampling import permuted, sample_rows
from arborlake.operators.encode import dictionary

#: Distinct values, over all columns, whose ranks are broadcast; and ranges that a column of more is ranked in.
FEW_VALUES, RANGES = 500_000, 64


def groups_of(features: list | dict | str | None, columns: list[str]) -> dict[str, list[str]]:
    """{name: columns} from a name, a place, a list of these, or a dict of groups; None: each column alone."""
    if features is None:
        return {c: [c] for c in columns}
    if isinstance(features, dict):
        return {k: [_named(c, columns) for c in ([v] if isinstance(v, (str, int)) else v)] for k, v in features.items()}
    return {_named(c, columns): [_named(c, columns)] for c in ([features] if isinstance(features, (str, int)) else features)}


def _named(feature: str | int, columns: list[str]) -> str:
    name = columns[feature] if isinstance(feature, int) and -len(columns) <= feature < len(columns) else feature
    if name not in columns:
        raise ValueError(f"unknown feature {feature!r}")
    return name


def _metric(metric: str | Callable, y: str, p: str) -> Column:
    return METRICS[metric](y, p) if isinstance(metric, str) else metric(y, p)


def permutation_importance(model, df: DataFrame, y: str, key: str, features=None, *, n_repeats: int = 5, n_samples: int | None = 5000, metric: str | Callable | None = None, seed: int = 42) -> DataFrame:
    """(feature, importance, std): how much the metric falls when a group's columns are shuffled together.

    All variants of the bounded sample are scored in one job.
    """
    columns = model.encoder.columns
    metric = metric or ("accuracy" if model.classes_ is not None else "r2")
    some = (sample_rows(df, n_samples, seed, "analysis", key) if n_samples else df).select(key, y, *columns)
    variants = [some.withColumn("feature", F.lit(None).cast("string")).withColumn("repeat", F.lit(0))]
    for name, group in groups_of(features, columns).items():
        for r in range(n_repeats):
            variants.append(permuted(some, group, key, seed, f"permute:{name}:{r}").withColumn("feature", F.lit(name)).withColumn("repeat", F.lit(r)))
    every = variants[0]
    for v in variants[1:]:
        every = every.unionByName(v)
    scores = model.transform(every).groupBy("feature", "repeat").agg(_metric(metric, y, "prediction").alias("score"))
    base = scores.filter("feature IS NULL").select(F.col("score").alias("base"))
    return scores.filter("feature IS NOT NULL").crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("score")).alias("importance"), F.stddev_pop(F.col("base") - F.col("score")).alias("std"))


def drop_column_importance(estimator, train: DataFrame, valid: DataFrame, y: str, key: str, features=None, *, metric: str | Callable | None = None, n_train: int = 40_000, n_valid: int = 5000, seed: int = 42) -> DataFrame:
    """(feature, importance): how much the metric on valid rows falls without a group's columns, refitted."""
    columns = [c for c in train.columns if c not in (y, key)]
    metric = metric or ("accuracy" if estimator.classification else "r2")
    train, valid = sample_rows(train, n_train, seed, "train", key), sample_rows(valid, n_valid, seed, "valid", key)

    def score(kept: list[str]) -> float:
        return estimator.fit(train, y, kept, key=key).transform(valid).agg(_metric(metric, y, "prediction")).first()[0]

    base = score(columns)
    rows = [(name, float(base - score([c for c in columns if c not in group]))) for name, group in groups_of(features, columns).items()]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double")


def grid_of(df: DataFrame, column: str, points: int, whole: bool = False) -> list:
    """Values to try: all if at most 20 (or points), else evenly spaced distinct ones, or quantiles."""
    distinct = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(21).collect()]
    if len(distinct) <= 20:
        return distinct
    if whole or df.schema[column].dataType.typeName() == "string":
        every = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
        return [every[i] for i in sorted(set(np.linspace(0, len(every) - 1, points).round().astype(int).tolist()))]
    return sorted(set(df.agg(F.percentile(column, F.array(*(F.lit(float(q)) for q in np.linspace(0, 1, points))))).first()[0]))


def partial_dependence(model, df: DataFrame, key: str, features, *, grid_points: int = 20, n_samples: int | None = 500, seed: int = 42, individual: bool = False) -> DataFrame:
    """(feature or feature_1 and feature_2, average[, key and prediction]) over a grid, on a bounded sample.

    features: a column, two columns (a surface), a bundle's name, or {name: one-hot columns}. For
    classifiers the average is of the last class's probability.
    """
    some = (sample_rows(df, n_samples, seed, "pdp", key) if n_samples else df).persist()
    try:
        bundle = {f.name: f.sources for f in model.encoder.features if f.kind == "bundle"}
        if isinstance(features, str) and features in bundle:
            features = {features: ["(none)", *bundle[features]]}
        if isinstance(features, dict):
            (name, members), = features.items()
            grids = {name: list(members)}
            tried = some.withColumn("_0", F.explode(F.array(*map(F.lit, members))))
            for m in (m for m in members if m != "(none)"):
                tried = tried.withColumn(m, (F.col("_0") == m).cast("int").cast(some.schema[m].dataType))
        else:
            chosen = [_named(f, model.encoder.columns) for f in ([features] if isinstance(features, (str, int)) else features)]
            grids = {c: grid_of(some, c, grid_points, model.encoder.profile[c]["all_int"]) for c in chosen}
            tried = some
            for i, (c, grid) in enumerate(grids.items()):
                tried = tried.withColumn(f"_{i}", F.explode(F.array(*map(F.lit, grid)))).withColumn(c, F.col(f"_{i}").cast(some.schema[c].dataType))
        scored = model.transform(tried) if model.classes_ is None else model.probabilities(tried, "_p").withColumn("prediction", F.element_at("_p", -1))
        names = list(grids)
        by = [F.col(f"_{i}").alias(n if len(names) == 1 else f"feature_{i + 1}") for i, n in enumerate(names)]
        out = scored.select(key, *by, "prediction") if individual else scored.groupBy(*by).agg(F.avg("prediction").alias("average"))
        rows = out.collect()
        return df.sparkSession.createDataFrame(rows, out.schema)
    finally:
        some.unpersist()


def clustered_ice(curves: np.ndarray, n_clusters: int = 5, centred: bool = True, seed: int = 42) -> np.ndarray:
    """Mean curves of k-means clusters, at most 50 rounds, of a bounded sample's curves (rows)."""
    x = curves - curves[:, :1] if centred else curves
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n_clusters, len(x)), replace=False)]
    for _ in range(50):
        nearest = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([x[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _values(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, list | None]]:
    """(rows, {column: bounds of its ranges}), columns of fewest distinct values first; None: few enough to broadcast.

    Distinct values are counted before they move and sorted by range; a row a range comes to the driver. Any bounds
    give the same ranks: they only say which values are ranked in one task.
    """
    alike: dict[T.DataType, list[int]] = {}
    for i, c in enumerate(columns):
        alike.setdefault(df.schema[c].dataType, []).append(i)
    rows, found = 0, {c: [] for c in columns}
    for some in alike.values():
        pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(columns[i]).alias("v")) for i in some))
        counted = df.select(F.explode(pairs).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
        ranged = counted.repartitionByRange("i", "v").withColumn("at", F.spark_partition_id())
        of_range = ranged.groupBy("i", "at").agg(F.min("v").alias("first"), F.sum("n").alias("n"), F.count("*").alias("values"))
        for r in of_range.orderBy("i", "first").collect():
            found[columns[r["i"]]].append(r)
    out, before = {}, 0
    for c in sorted(found, key=lambda c: sum(r["values"] for r in found[c])):
        before += sum(r["values"] for r in found[c])
        bounds = [r["first"] for r in found[c] if r["first"] is not None][1:]
        out[c] = None if before <= FEW_VALUES else [bounds[i * len(bounds) // RANGES] for i in range(min(RANGES, len(bounds)))] if len(bounds) > RANGES else bounds
        rows = sum(r["n"] for r in found[c])
    return rows, out


def _range_of(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, by halving; 0 for null, which sorts first."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value >= F.lit(bounds[half]), _range_of(value, bounds[half + 1 :], first + half + 1)).otherwise(_range_of(value, bounds[:half], first))


def _value_ranks(df: DataFrame, column: str, bounds: list | None) -> DataFrame:
    """(_v, _rank): the average rank of each distinct value."""
    counted = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not bounds:
        return counted.select("_v", (F.sum("_n").over(upto) - (F.col("_n") + 1) / 2.0).alias("_rank"))
    parted = counted.withColumn("_part", _range_of(F.col("_v"), bounds))
    before = parted.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    within = parted.withColumn("_upto", F.sum("_n").over(upto.partitionBy("_part")))
    return within.join(F.broadcast(before), "_part").select("_v", (F.col("_before") + F.col("_upto") - (F.col("_n") + 1) / 2.0).alias("_rank"))


def _ranked(df: DataFrame, columns: list[str]) -> tuple[int, DataFrame]:
    """(rows, the columns as average ranks): distinct values are ranked, and rows look theirs up."""
    instants = [c for c in columns if isinstance(df.schema[c].dataType, T.TimestampType)]
    known = df.select(*(F.unix_micros(c).alias(c) if c in instants else F.col(c) for c in dict.fromkeys(columns)))
    rows, values = _values(known, known.columns)
    out = known
    for c, bounds in values.items():
        ranks = _value_ranks(known, c, bounds)
        found = out.join(F.broadcast(ranks) if bounds is None else ranks, F.col(c).eqNullSafe(F.col("_v")))
        out = found.withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return rows, out.select(*columns)


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's columns as 0-based ranks, ties averaged. No task sorts rows: only distinct values are, by range.

    df is read several times and has to give the same rows each time.
    """
    return _ranked(df, columns)[1]


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) for all pairs of columns; undefined ones are 0, a column's own 1."""
    rows, ranks = _ranked(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    # the mean of average ranks is known, so sums of products of what is over it are enough
    over = {c: F.col(c) - (rows - 1) / 2.0 for c in columns}
    sums = ranks.agg(*(F.sum(over[c] * over[c]).alias(f"s{i}") for i, c in enumerate(columns)), *(F.sum(over[a] * over[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    spread = {c: F.sqrt(f"s{i}") for i, c in enumerate(columns)}
    known = [(x, y, F.when(spread[a] * spread[b] > 0, F.col(f"c{i}") / (spread[a] * spread[b])).otherwise(0.0)) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    known += [(c, c, F.lit(1.0)) for c in columns]
    return sums.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("correlation")) for a, b, c in known))).alias("x")).select("x.*")


def linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Average-linkage merges (left, right, distance, size) of a distance matrix over features."""
    n = len(distance)
    size, d = {i: 1 for i in range(n)}, {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for step in range(n - 1):
        (a, b), least = min(d.items(), key=lambda x: (x[1], x[0]))
        new = n + step
        for k in list(size):
            if k not in (a, b):
                da, db = d.pop((min(a, k), max(a, k))), d.pop((min(b, k), max(b, k)))
                d[k, new] = (size[a] * da + size[b] * db) / (size[a] + size[b])
        del d[a, b]
        size[new] = size.pop(a) + size.pop(b)
        out.append((a, b, least, size[new]))
    return out


def feature_relations(df: DataFrame, columns: list[str], key: str, *, n_samples: int | None = 5000, seed: int = 42) -> dict:
    """{"names", "correlation", "linkage"} of a sample, or of all rows: distances are 1 - |correlation|."""
    some = sample_rows(df, n_samples, seed, "relations", key).select(*columns).persist() if n_samples else df
    place = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    try:
        for a, b, c in spearman(some, columns).collect():
            matrix[place[a], place[b]] = c
    finally:
        if n_samples:
            some.unpersist()
    return {"names": columns, "correlation": matrix, "linkage": linkage(1 - np.abs(matrix))}


def related_groups(relations: dict, threshold: float = 0.2) -> list[tuple[str, ...]]:
    """Largest groups merged within the threshold, then the features that are alone."""
    members = {i: (i,) for i in range(len(relations["names"]))}
    for step, (a, b, d, _) in enumerate(relations["linkage"]):
        if d <= threshold and a in members and b in members:
            members[len(relations["names"]) + step] = members.pop(a) + members.pop(b)
    found = [tuple(relations["names"][i] for i in sorted(g)) for g in members.values()]
    return sorted(found, key=lambda g: (len(g) == 1, relations["names"].index(g[0])))


def feature_dependence(df: DataFrame, columns: list[str], key: str, *, n_samples: int | None = 5000, n_trees: int = 25, seed: int = 42) -> DataFrame:
    """(target, feature, predictability, importance): how well each feature follows from the others.

    Texts are predicted as ranks of their sorted values; rows without the target do not count for it.
    ValueError for fewer than two features or five rows.
    """
    from arborlake.functions.sampling import split
    from arborlake.operators.forest import ForestRegressor

    if len(columns) < 2:
        raise ValueError("at least two features are needed")
    some = (sample_rows(df, n_samples, seed, "dependence", key) if n_samples else df).select(key, *columns)
    if some.limit(5).count() < 5:
        raise ValueError("at least five rows are needed")
    out = []
    for target in columns:
        rest = [c for c in columns if c != target]
        known = some.filter(F.col(target).isNotNull())
        if isinstance(df.schema[target].dataType, T.NumericType):
            ranked = known.withColumn("_target", F.col(target).cast("double"))
        else:
            values = dictionary(known.withColumn(target, F.col(target).cast("string")), target).select(F.col("value").alias("_value"), F.col("rank").cast("double").alias("_target"))
            ranked = known.join(values, F.col(target).cast("string") == F.col("_value")).drop("_value")
        train, valid = split(ranked, 0.8, seed, key)
        model = ForestRegressor(n_trees=n_trees, seed=seed).fit(train, "_target", rest, key=key)
        r2 = model.transform(valid).agg(METRICS["r2"]("_target", "prediction")).first()[0]
        for r in permutation_importance(model, valid, "_target", key, n_repeats=1, seed=seed).collect():
            out.append((target, r["feature"], float(r2), max(0.0, float(r["importance"]))))
    return df.sparkSession.createDataFrame(out, "target string, feature string, predictability double, importance double")
