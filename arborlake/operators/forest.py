"""Forests: fit on a bounded, hash-sampled pool, a task a tree; score any table in one projection."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from arborlake.functions.sampling import dense_index, sample_rows, tree_samples
from arborlake.functions.scalars import DATE_PARTS, date_part, date_part_names, parse_date, parsed_number, without_marker
from arborlake.operators import encode, kernel
from arborlake.plans.config import Config, features_per_node, plan_fit, resolve_replacement

#: Rows that bundles are looked for in, at most.
BUNDLE_ROWS = 10_000
#: Encoded rows of a pool that a task is worth starting for.
TASK_ROWS = 50_000


@dataclass
class Feature:
    """An encoded feature: of the raw columns ``sources``; texts have sorted distinct ``values``."""

    name: str
    kind: str  # numeric, lexical, bundle or date
    sources: list[str]
    values: list | None = None
    format: str | None = None
    part: str | None = None
    had_missing: bool = True
    all_int: bool = False


@dataclass
class Encoder:
    """The fitted schema: column profiles and encoded features."""

    columns: list[str]
    features: list[Feature]
    profile: dict[str, dict]
    markers: dict
    date_columns: dict[str, str]
    allow_new_missing: bool = False

    @staticmethod
    def fit(pool: DataFrame, columns: list[str], config: Config, key: str, detect_dates: bool = True) -> Encoder:
        encode.check_types(pool, columns)
        markers = named(config.missing_values, columns)
        found = {r["column"]: r.asDict() for r in encode.profile(pool, columns, markers).collect()}
        if bad := [c for c, r in found.items() if r["non_finite"] and r["kind"] == "numeric"]:
            raise ValueError(f"non-finite numeric value in {bad[0]!r}")
        dates = named(config.date_columns, columns) if config.date_columns is not None else {}
        if config.date_columns is None and detect_dates:
            texts = [c for c in columns if found[c]["kind"] != "discarded" and not isinstance(pool.schema[c].dataType, (T.BooleanType, T.FloatType, T.DoubleType))]
            dates = encode.detect_dates(pool, texts, key, seed=config.seed or 0) if texts else {}
        flags = [c for c in columns if c not in dates and found[c]["missing"] == 0 and found[c]["distinct_values"] == 2]
        groups = encode.bundles(sample_rows(pool, BUNDLE_ROWS, config.seed or 0, "bundles", key), flags, columns) if len(flags) > 1 else []
        taken = {c for _, members in groups for c in members} | set(dates)
        features = [
            Feature(c, found[c]["kind"], [c], had_missing=found[c]["missing"] > 0, all_int=found[c]["all_int"])
            for c in columns
            if c not in taken and found[c]["kind"] != "discarded"
        ]
        features += [Feature(name, "bundle", members, had_missing=False) for name, members in groups]
        features += [Feature(n, "date", [c], format=f, part=p) for c, f in dates.items() for n, p in zip(date_part_names(c), DATE_PARTS, strict=True)]
        if len({f.name for f in features}) < len(features):
            raise ValueError("automatic bundle and feature names must be unique")
        lexical = [f for f in features if f.kind == "lexical"]
        if lexical:
            pairs = F.array(*(F.struct(F.lit(i).alias("i"), without_marker(encode.as_text(pool, f.sources[0]), markers.get(f.sources[0], "")).alias("v")) for i, f in enumerate(lexical)))
            for i, values in pool.select(F.explode(pairs).alias("x")).filter("x.v IS NOT NULL").groupBy("x.i").agg(F.array_sort(F.collect_set("x.v"))).collect():
                lexical[i].values = values
        return Encoder(columns, features, found, markers, dates, config.allow_new_missing)

    def raw(self, df: DataFrame, f: Feature) -> Column:
        """A feature's value as a double, or as text for lexical ones; null where missing."""
        if f.kind == "numeric" and self.markers.get(f.sources[0], "") in ("", None) and isinstance(df.schema[f.sources[0]].dataType, T.NumericType):
            number = F.col(f"`{f.sources[0]}`").cast("double")
            finite = F.abs(number) < float("inf")
            return F.when(number.isNotNull() & ~finite, F.raise_error(F.lit(f"non-finite numeric value in {f.name!r}")).cast("double")).otherwise(number)
        text = [without_marker(encode.as_text(df, c), self.markers.get(c, "")) for c in f.sources]
        if f.kind == "lexical":
            return text[0]
        if f.kind == "date":
            return date_part(parse_date(text[0], f.format), f.part).cast("double")
        if f.kind == "bundle":
            return encode.bundle_code([parsed_number(t) for t in text]).cast("double")
        number = parsed_number(text[0])
        return F.when(text[0].isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"non-finite or non-numeric value in {f.name!r}: "), text[0])).cast("double")).otherwise(number)

    def native(self, df: DataFrame, strict: bool = False) -> list[Column]:
        """A double column for each feature; with strict, new missing values are an error unless allowed."""
        out = []
        for f in self.features:
            value = self.raw(df, f)
            if strict and not self.allow_new_missing and not f.had_missing and f.kind != "date":
                value = F.when(value.isNull(), F.raise_error(F.lit(f"feature {f.name!r} has missing values but had none during training")).cast("string" if f.kind == "lexical" else "double")).otherwise(value)
            out.append(positions(f.values or [])(value) if f.kind == "lexical" else value)
        return out

    def display(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep, then each feature as people read it: texts, whole numbers as such, names of a bundle's members."""
        shown = []
        for f in self.features:
            value = self.raw(df, f)
            if f.kind == "bundle":
                value = F.element_at(F.array(F.lit("(none)"), *map(F.lit, f.sources)), value.cast("int") + 1)
            elif f.kind == "date" or f.all_int:
                value = value.cast("long")
            shown.append(value.alias(f.name))
        return df.select(*keep, *shown)

    def column_info(self, spark: SparkSession) -> DataFrame:
        """(column, kind, cardinality, had_missing, all_int, features) for each raw column."""
        of = {c: [f.name for f in self.features if c in f.sources] for c in self.columns}
        rows = [(c, "date" if c in self.date_columns else self.profile[c]["kind"], int(self.profile[c]["distinct_values"]), self.profile[c]["missing"] > 0, self.profile[c]["all_int"], ",".join(of[c])) for c in self.columns]
        return spark.createDataFrame(rows, "column string, kind string, cardinality long, had_missing boolean, all_int boolean, features string")

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "features": [asdict(f) for f in self.features], "profile": self.profile, "markers": [[k, v] for k, v in self.markers.items()], "dates": self.date_columns, "allow_new_missing": self.allow_new_missing})

    @staticmethod
    def from_json(text: str) -> Encoder:
        d = json.loads(text)
        return Encoder(d["columns"], [Feature(**f) for f in d["features"]], d["profile"], {k: v for k, v in d["markers"]}, d["dates"], d["allow_new_missing"])


def named(given: dict | list | None, columns: list[str]) -> dict:
    """A setting by column name, from a dict by name or place, or a list for all columns."""
    if given is None:
        return {}
    if isinstance(given, (list, tuple)):
        if len(given) != len(columns):
            raise ValueError(f"expected {len(columns)} values, got {len(given)}")
        return dict(zip(columns, given, strict=True))
    out = {}
    for k, v in given.items():
        name = columns[k] if isinstance(k, int) and 0 <= k < len(columns) else k
        if name not in columns:
            raise ValueError(f"unknown column {k!r}")
        out[name] = v
    return out


def positions(values: list[str]):
    """Texts to ranks in sorted values; unseen ones lie half below the next rank. Byte order throughout."""
    table = np.array([v.encode() for v in values], object)

    @pandas_udf("double")
    def ranks(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        out = np.full(len(texts), np.nan)
        raw = np.array([t.encode() for t in texts[known]], object)
        if len(raw):
            at = np.searchsorted(table, raw, "left")
            same = (at < len(table)) & (table[np.minimum(at, len(table) - 1)] == raw) if len(table) else np.zeros(len(raw), bool)
            out[known] = np.where(same, at, at - 0.5)
        return pd.Series(out).where(known, None)

    return ranks


_NODES = "config_id int, tree_id int, node_id long, feature int, kind int, cut double, missing_right boolean, left_id long, n double, gain double, depth int, value array<double>"


def _tree(rows: pd.DataFrame, width: int, classes: int, config: Config) -> pd.DataFrame:
    rows = rows.sort_values("draw_id")
    tree_id, config_id = int(rows["tree_id"].iloc[0]), int(rows["config_id"].iloc[0]) if "config_id" in rows else 0
    x = rows[[f"f{i}" for i in range(width)]].to_numpy(np.float64)
    values, ranks, cardinality = [], np.zeros(x.shape, np.int64), np.zeros(width, np.int64)
    for f in range(width):
        known = ~np.isnan(x[:, f])
        distinct, inverse = np.unique(x[known, f] + 0.0, return_inverse=True)
        values.append(distinct if len(distinct) else np.zeros(1))
        cardinality[f] = len(distinct)
        ranks[known, f], ranks[~known, f] = inverse, len(distinct)
    y = rows["y"].to_numpy(np.int64 if classes else np.float64)
    seed = int.from_bytes(hashlib.md5(f"{config.seed or 0}:{tree_id}".encode()).digest()[:8], "little")
    tree = kernel.grow_tree(ranks, y, cardinality, classes=classes, features=features_per_node(config.max_features, width) if width else 0, min_node=config.min_node_size, window=config.max_node_samples, prior=config.split_prior_rows, power=config.class_weight_power, random_splitter=config.random_splitter, divisor=config.cutoff_divisor, seed=seed)
    cut = [float(values[f][c]) if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["cut"], strict=True)]
    value = tree["value"].tolist() if classes else [[v] for v in tree["value"]]
    return pd.DataFrame({"config_id": config_id, "tree_id": tree_id, "node_id": range(len(cut)), "feature": tree["feature"], "kind": tree["kind"], "cut": cut, "missing_right": tree["missing_right"], "left_id": tree["left"], "n": tree["n"], "gain": tree["gain"], "depth": tree["depth"], "value": value})


def _grower(width: int, classes: int, config: Config):
    return lambda rows: _tree(rows, width, classes, config)


def packed_trees(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    out = []
    for _, t in nodes.sort_values(["tree_id", "node_id"]).groupby("tree_id"):
        value = np.stack([np.asarray(v, np.float64) for v in t["value"]])
        out.append({"feature": t["feature"].to_numpy(), "kind": t["kind"].to_numpy(), "cut": t["cut"].to_numpy(), "missing_right": t["missing_right"].to_numpy().astype(np.int64), "left": t["left_id"].to_numpy(), "value": value})
    return out


class ForestModel:
    """A fitted forest. ``nodes`` is a pandas table, a row a node; ``classes_`` is None for regression."""

    def __init__(self, spark: SparkSession, config: Config, encoder: Encoder, nodes: pd.DataFrame, classes: list | None, label: str, oob: DataFrame | None = None) -> None:
        self.spark, self.config, self.encoder, self.nodes, self.classes_, self.label, self.oob_ = spark, config, encoder, nodes, classes, label, oob
        self.feature_names_in_, self.n_features_in_ = tuple(encoder.columns), len(encoder.columns)
        self.encoded_names = [f.name for f in encoder.features]
        self.n_trees_ = int(nodes["tree_id"].nunique())

    # structure
    def _nodes(self) -> DataFrame:
        return self.spark.createDataFrame(self.nodes, _NODES)

    @property
    def tree_node_counts_(self) -> np.ndarray:
        return self.nodes.groupby("tree_id").size().to_numpy()

    @property
    def tree_leaf_counts_(self) -> np.ndarray:
        return (self.nodes["feature"] < 0).groupby(self.nodes["tree_id"]).sum().to_numpy()

    @property
    def tree_depths_(self) -> np.ndarray:
        return self.nodes.groupby("tree_id")["depth"].max().to_numpy()

    @property
    def encoded_importances_(self) -> np.ndarray:
        inner = self.nodes[self.nodes["feature"] >= 0]
        total = np.bincount(inner["feature"], inner["gain"] * inner["n"], len(self.encoded_names))
        return total / total.sum() if total.sum() > 0 else total

    @property
    def feature_importances_(self) -> np.ndarray:
        """By raw column; a bundle's share goes to its members evenly, a date's parts are summed."""
        out = dict.fromkeys(self.encoder.columns, 0.0)
        for f, v in zip(self.encoder.features, self.encoded_importances_, strict=True):
            for c in f.sources:
                out[c] += v / len(f.sources)
        return np.array(list(out.values()))

    def split_importance(self) -> DataFrame:
        """(feature, importance), largest first."""
        return self.spark.createDataFrame(list(zip(self.encoded_names, map(float, self.encoded_importances_), strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def split_counts_by_depth(self) -> DataFrame:
        inner = self._nodes().filter("feature >= 0")
        return inner.groupBy("feature", "depth").agg(F.count("*").alias("splits"), F.sum((F.col("kind") == kernel.EQ).cast("long")).alias("equality"))

    # scoring
    def _udf(self, score, returns: str):
        trees, width = packed_trees(self.nodes), len(self.encoder.features)

        @pandas_udf(returns)
        def run(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns[:width]], 1) if width else np.zeros((len(columns[0]), 0))
            return pd.Series(list(score(trees, x)))

        return run

    def _apply(self, df: DataFrame, score, returns: str) -> Column:
        if missing := [c for c in self.encoder.columns if c not in df.columns]:
            raise ValueError(f"missing columns: {missing}")
        columns = self.encoder.native(df, strict=True)
        return self._udf(score, returns)(*(columns or [F.lit(0.0)]))

    def transform(self, df: DataFrame, *, proba: bool = False) -> DataFrame:
        """df with prediction, or with a proba_<class> column for each class; a projection without a shuffle."""
        if self.classes_ is None:
            return df.withColumn("prediction", self._apply(df, _mean_values, "float"))
        out = df.withColumn("_p", self._apply(df, _class_probabilities, "array<double>"))
        if proba:
            return out.select(*df.columns, *(F.col("_p")[i].alias(f"proba_{c}") for i, c in enumerate(self.classes_)))
        labels = F.array(*map(F.lit, self.classes_))
        return out.withColumn("prediction", F.element_at(labels, F.array_position("_p", F.array_max("_p")).cast("int"))).drop("_p")

    def probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self._apply(df, _class_probabilities, "array<double>"))

    def predict_trees(self, df: DataFrame) -> DataFrame:
        """df with trees: each tree's prediction."""
        return df.withColumn("trees", self._apply(df, _tree_values, "array<double>"))

    def predict_std(self, df: DataFrame) -> DataFrame:
        """df with std: the spread of the trees' predictions, over all trees."""
        mean = F.aggregate("trees", F.lit(0.0), lambda a, v: a + v) / F.size("trees")
        square = F.aggregate("trees", F.lit(0.0), lambda a, v: a + v * v) / F.size("trees")
        return self.predict_trees(df).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))).drop("trees")

    def explain(self, df: DataFrame, key: str) -> DataFrame:
        """(key, prediction, bias, feature, contribution): the prediction is the bias plus the contributions."""
        width = len(self.encoder.features)
        out = df.withColumn("_c", self._apply(df, _explanations(width), "array<double>"))
        parts = F.posexplode(F.slice("_c", 2, width)).alias("i", "contribution")
        rows = out.select(key, F.col("_c")[0].alias("bias"), F.aggregate("_c", F.lit(0.0), lambda a, v: a + v).alias("prediction"), parts)
        return rows.withColumn("feature", F.element_at(F.array(*map(F.lit, self.encoded_names)), F.col("i") + 1)).drop("i")

    # combination and storage
    def combined(self, other: ForestModel) -> ForestModel:
        """The forest of both's trees; both have one encoder. Out-of-bag means weigh by their counts."""
        if self.encoder.to_json() != other.encoder.to_json():
            raise ValueError("forests have different encoders")
        moved = other.nodes.assign(tree_id=other.nodes["tree_id"] + self.nodes["tree_id"].max() + 1)
        oob = None
        if self.oob_ is not None and other.oob_ is not None:
            both = self.oob_.unionByName(other.oob_)
            width = len(self.classes_) if self.classes_ is not None else 1
            n = F.sum("count")
            oob = both.groupBy("row_id").agg(n.alias("count"), F.array(*(F.sum(F.col("mean")[i] * F.col("count")) / n for i in range(width))).alias("mean"), F.first("y").alias("y"))
        return ForestModel(self.spark, self.config, self.encoder, pd.concat([self.nodes, moved], ignore_index=True), self.classes_, self.label, oob)

    def save(self, path: str) -> None:
        """A folder with nodes and metadata as Parquet, in any store that Spark writes; commits are atomic per table."""
        about = json.dumps({"version": 1, "config": {f.name: getattr(self.config, f.name) for f in fields(Config) if f.name not in ("extra", "missing_values", "date_columns")}, "encoder": self.encoder.to_json(), "classes": self.classes_, "label": self.label})
        self._nodes().coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        self.spark.createDataFrame([(about,)], "metadata string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        """Reads and checks a saved model; ValueError where it is damaged."""
        about = json.loads(spark.read.parquet(f"{path}/metadata").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        encoder = Encoder.from_json(about["encoder"])
        check_nodes(nodes, len(encoder.features), len(about["classes"]) if about["classes"] is not None else 0)
        return ForestModel(spark, Config(**about["config"]), encoder, nodes, about["classes"], about["label"])


def check_nodes(nodes: pd.DataFrame, width: int, classes: int) -> None:
    size = nodes.groupby("tree_id")["node_id"].transform("size")
    inner = nodes["feature"] >= 0
    bad = (nodes["feature"] >= width) | (inner & ((nodes["left_id"] <= nodes["node_id"]) | (nodes["left_id"] + 1 >= size)))
    if bad.any():
        raise ValueError("saved model has an invalid node")
    if (nodes["value"].map(len) != max(1, classes)).any() or not np.isfinite(np.concatenate(nodes["value"].to_numpy())).all():
        raise ValueError("saved model has invalid values")


def _mean_values(trees, x):
    return sum((t["value"][kernel.leaves(t, x), 0] for t in trees), np.zeros(len(x))) / len(trees)


def _tree_values(trees, x):
    return np.stack([t["value"][kernel.leaves(t, x), 0] for t in trees], 1)


def _class_probabilities(trees, x):
    return sum((t["value"][kernel.leaves(t, x)] for t in trees), np.zeros((len(x), trees[0]["value"].shape[1]))) / len(trees)


def _leaf_values(trees, x):
    return np.concatenate([t["value"][kernel.leaves(t, x)] for t in trees], 1)


def _explanations(width):
    def run(trees, x):
        out = np.zeros((len(x), 1 + width))
        for t in trees:
            bias, c = kernel.contributions({**t, "value": t["value"][:, 0]}, x, width)
            out[:, 0] += bias
            out[:, 1:] += c
        return out / len(trees)

    return run


class _Forest:
    classification = False

    def __init__(self, **parameters) -> None:
        default = {"max_features": 0.6 if self.classification else 0.9}
        self.config = Config(**{**default, **parameters}).checked()

    def get_params(self) -> dict:
        return {f.name: getattr(self.config, f.name) for f in fields(Config) if f.name != "extra"}

    def fit(self, df: DataFrame, label: str, features: list[str] | None = None, *, key: str | None = None, detect_dates: bool = True) -> ForestModel:
        return self.fit_many(df, label, {0: self.config}, features, key=key, detect_dates=detect_dates)[0]

    def fit_many(self, df: DataFrame, label: str, configs: dict[int, Config], features: list[str] | None = None, *, key: str | None = None, detect_dates: bool = True) -> dict[int, ForestModel]:
        """A model for each configuration on one pool and one encoding; each equals a fit of its own.

        key names a column that identifies rows; without one a hash of the whole row serves.
        """
        pool = self.pool(df, label, list(configs.values()), features, key=key, detect_dates=detect_dates)
        try:
            return {i: pool.grown(c) for i, c in configs.items()}
        finally:
            pool.release()

    def pool(self, df: DataFrame, label: str, configs: list[Config], features: list[str] | None = None, *, key: str | None = None, detect_dates: bool = True) -> Pool:
        """The sampled and encoded rows that forests of these configurations learn from; release() it in the end."""
        for c in configs:
            c.checked()
        features = features or [c for c in df.columns if c not in (label, key)]
        row_key = F.col(key).cast("string") if key else F.sha2(F.to_json(F.struct("*")), 256)
        table = df.select(row_key.alias("_key"), F.col(f"`{label}`").alias("_y"), *(F.col(f"`{c}`") for c in features))
        classes = None
        if self.classification:
            n = table.count()
        else:
            number = F.col("_y").cast("double")
            bad = number.isNull() | F.isnan(number) | number.isin(float("inf"), float("-inf"))
            n, wrong = table.agg(F.count("*"), F.count(F.when(bad, 1))).first()
        if not n:
            raise ValueError("X must contain at least one row")
        if self.classification:
            classes = [r[0] for r in encode.class_dictionary(table, "_y").orderBy("class_id").select("_y").collect()]
        elif wrong:
            raise ValueError("y must contain only finite values")
        outputs, base = max(1, len(classes) - 1) if classes else 1, configs[0]
        rows = max(plan_fit(n, c, outputs).pool_rows for c in configs)
        pool = sample_rows(table, rows, base.seed or 0, "pool", "_key").persist()
        try:
            encoder = Encoder.fit(pool, features, base, "_key", detect_dates)
            y = F.array_position(F.array(*map(F.lit, classes)), F.col("_y")) - 1 if classes else F.col("_y").cast("double")
            native = [c.alias(f"f{i}") for i, c in enumerate(encoder.native(pool))]
            tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(rows, n) // TASK_ROWS)
            indexed = dense_index(pool.select(F.col("_key").alias("row_id"), y.alias("y"), *native), "row_id", tasks=tasks).persist()
            return Pool(df.sparkSession, indexed, indexed.count(), n, outputs, encoder, classes, label)
        finally:
            pool.unpersist()


@dataclass
class Pool:
    """Encoded rows with a dense index: ``size`` of a table's ``rows``. Forests of one pool can be combined."""

    spark: SparkSession
    indexed: DataFrame
    size: int
    rows: int
    outputs: int
    encoder: Encoder
    classes: list | None
    label: str
    tracked: dict[tuple[int, int], DataFrame] = field(default_factory=dict)

    def tracking(self, rows: int, seed: int) -> DataFrame:
        """Rows that out-of-bag predictions are followed on; their cut is looked for once."""
        if (rows, seed) not in self.tracked:
            self.tracked[rows, seed] = sample_rows(self.indexed, rows, seed, "oob", "row_id")
        return self.tracked[rows, seed]

    def grown(self, config: Config, tracked: DataFrame | None = None) -> ForestModel:
        """A forest of config; out-of-bag means are of the tracked rows, by default at most bootstrap_max of the pool."""
        plan, width = plan_fit(self.rows, config, self.outputs), len(self.encoder.features)
        replacement = resolve_replacement(config.replacement, self.rows, self.classes is not None)
        per_tree = plan.rows_per_tree if replacement else min(plan.rows_per_tree, self.size)
        rows = tree_samples(self.spark, self.indexed, plan.n_trees, per_tree, self.size, config.seed or 0, replacement)
        if config.oob:
            rows = rows.persist()  # drawn once, for the trees and for what is out of bag
        try:
            nodes = rows.groupBy("tree_id").applyInPandas(_grower(width, len(self.classes) if self.classes else 0, config), _NODES).toPandas()
            model = ForestModel(self.spark, config, self.encoder, nodes, self.classes, self.label)
            if config.oob:
                if tracked is None:
                    tracked = self.tracking(config.bootstrap_max or self.size, config.seed or 0)
                model.oob_ = self._oob(model, tracked, rows)
            return model
        finally:
            if config.oob:
                rows.unpersist()

    def release(self) -> None:
        self.indexed.unpersist()

    def _oob(self, model: ForestModel, tracked: DataFrame, rows: DataFrame) -> DataFrame:
        """(row_id, y, mean, count): over the trees that did not sample the row. As many rows at most as are tracked, kept by the driver."""
        size, width = len(self.classes) if self.classes is not None else 1, len(self.encoder.features)
        leaf = tracked.select("row_id", "y", model._udf(_leaf_values, "array<double>")(*(F.col(f"f{i}") for i in range(width))).alias("v"))
        spread = leaf.select("row_id", "y", "v", F.posexplode(F.sequence(F.lit(0), F.lit(model.n_trees_ - 1))).alias("tree_id", "_t"))
        spread = spread.select("row_id", "y", "tree_id", F.slice("v", F.col("tree_id") * size + 1, size).alias("v"))
        outside = spread.join(rows.select("tree_id", "row_id").distinct(), ["tree_id", "row_id"], "left_anti")
        mean = F.array(*(F.avg(F.col("v")[i]) for i in range(size)))
        found = outside.groupBy("row_id").agg(F.first("y").alias("y"), mean.alias("mean"), F.count("*").alias("count"))
        return self.spark.createDataFrame(found.toArrow(), found.schema)


class ForestRegressor(_Forest):
    """Approximate random forest for a numeric target."""


class ForestClassifier(_Forest):
    """Approximate random forest for classes."""

    classification = True


def oob_score(model: ForestModel) -> float:
    """Out-of-bag R2, or accuracy for classes."""
    from arborlake.functions.metrics import r2

    if model.oob_ is None:
        raise ValueError("the forest was fitted without oob=True")
    if model.classes_ is None:
        return model.oob_.select("y", F.col("mean")[0].alias("p")).agg(r2("y", "p")).first()[0]
    best = F.array_position("mean", F.array_max("mean")) - 1
    return model.oob_.agg(F.avg((best == F.col("y")).cast("int"))).first()[0]
