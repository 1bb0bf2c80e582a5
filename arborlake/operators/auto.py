"""Sizing of samples and forests, and sweeps over configurations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.metrics import brier, mse
from arborlake.operators.forest import ForestClassifier, ForestModel, ForestRegressor
from arborlake.plans.config import Config

#: Sizes that are tried, for a forest of fixed and of growing length.
ROWS = {False: (80_000, 120_000, 160_000, 200_000), True: (80_000, 160_000, 240_000, 320_000)}
NODE_ROWS = {False: (640, 960, 1280), True: (640, 1280, 1920)}
SCREEN_TREES = 8
#: Rows that a growing forest's out-of-bag loss is measured on, for each output.
TRACKED = 40_000


def batch_seed(seed: int, batch: int) -> int:
    """The seed of a batch of trees, below 2**31."""
    return int.from_bytes(hashlib.md5(f"{seed}:batch:{batch}".encode()).digest()[:4], "little") >> 1


def loss(model: ForestModel, scored: DataFrame | None = None, y: str = "y") -> float:
    """Mean squared error, or the multiclass Brier score; out of bag where no scored table is given."""
    if scored is None:
        if model.oob_ is None or not model.oob_.limit(1).count():
            raise ValueError("no row is out of bag; sample less than all rows or with replacement")
        if model.classes_ is None:
            return model.oob_.select("y", F.col("mean")[0].alias("p")).agg(mse("y", "p")).first()[0]
        return model.oob_.agg(brier("mean", F.col("mean")[F.col("y").cast("int")])).first()[0]
    if model.classes_ is None:
        return model.transform(scored).agg(mse(y, "prediction")).first()[0]
    place = F.array_position(F.array(*map(F.lit, model.classes_)), F.col(y)).cast("int")
    true = F.when(place > 0, F.element_at("_p", F.when(place > 0, place)))
    return model.probabilities(scored, "_p").agg(brier("_p", true)).first()[0]


def justified(losses: list[float], least: float = 0.01) -> int:
    """How many levels up the improvements pay: a level needs ``least`` relative improvement a level."""
    base = losses[0]
    return max(min(level, int((base - found) / base / least + 1e-9)) if base > 0 else 0 for level, found in enumerate(losses))


@dataclass(frozen=True)
class Sweep:
    name: str
    changes: dict
    config: Config


def forest_suite(base: Config, axes: dict[str, list]) -> list[Sweep]:
    """The base and every change of one axis, without repeats."""
    out, seen = [Sweep("defaults", {}, base)], [base]
    for axis, values in axes.items():
        for v in values:
            config = base.but(**{axis: v}).checked()
            if config not in seen:
                seen.append(config)
                out.append(Sweep(f"{axis}={v}", {axis: v}, config))
    return out


def random_suite(base: Config, axes: dict[str, list], n: int, seed: int = 42) -> list[Sweep]:
    """The base and n distinct joint changes, each axis drawn at random; fewer if there are fewer."""
    import random

    rng, out, seen = random.Random(seed), [Sweep("defaults", {}, base)], [base]
    for _ in range(20 * n):
        changes = {axis: rng.choice(values) for axis, values in axes.items()}
        config = base.but(**changes).checked()
        if config not in seen and len(out) <= n:
            seen.append(config)
            out.append(Sweep(",".join(f"{k}={v}" for k, v in changes.items()), changes, config))
    return out


def screen(estimator, df: DataFrame, label: str, suite: list[Sweep], *, key: str | None = None) -> DataFrame:
    """(name, loss, relative, nodes, depth): out-of-bag losses of small forests on one pool and encoding."""
    configs = {i: s.config.but(n_trees=SCREEN_TREES, oob=True) for i, s in enumerate(suite)}
    if any(c.replacement is False and c.bootstrap_fraction is not None and c.bootstrap_fraction >= 1 for c in configs.values()):
        raise ValueError("screening needs out-of-bag rows")
    models = estimator.fit_many(df, label, configs, key=key)
    rows = [(s.name, float(loss(models[i])), float(models[i].tree_node_counts_.mean()), float(models[i].tree_depths_.mean())) for i, s in enumerate(suite)]
    return df.sparkSession.createDataFrame([(n, v, v / rows[0][1] if rows[0][1] else 1.0, c, d) for n, v, c, d in rows], "name string, loss double, relative double, nodes double, depth double")


def validate(estimator, train: DataFrame, valid: DataFrame, label: str, suite: list[Sweep], *, key: str | None = None) -> DataFrame:
    """(name, train_loss, validation_loss): ordinary fits of each configuration."""
    models = estimator.fit_many(train, label, {i: s.config for i, s in enumerate(suite)}, key=key)
    rows = [(s.name, float(loss(models[i], train, label)), float(loss(models[i], valid, label))) for i, s in enumerate(suite)]
    return train.sparkSession.createDataFrame(rows, "name string, train_loss double, validation_loss double")


def advisor_features(results: DataFrame, dataset: str = "dataset", baseline: str = "defaults") -> DataFrame:
    """Results with each loss relative to its dataset's baseline."""
    base = results.filter(F.col("name") == baseline).select(dataset, F.col("loss").alias("_base"))
    return results.join(base, dataset).withColumn("relative_loss", F.col("loss") / F.col("_base") - 1).drop("_base")


def advisor_regret(predicted: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, chosen, regret): the loss of the configuration predicted best, over the least loss."""
    chosen = predicted.groupBy(dataset).agg(F.min_by("name", F.struct("predicted_loss", "name")).alias("chosen"), F.min_by("loss", F.struct("predicted_loss", "name")).alias("_loss"), F.min("loss").alias("_best"))
    return chosen.select(dataset, "chosen", (F.col("_loss") / F.col("_best") - 1).alias("regret"))


class AutoForest:
    """A regressor that sizes its samples and, with autogrow, its number of trees by out-of-bag losses."""

    estimator = ForestRegressor

    def __init__(self, *, autogrow: bool = False, tree_batch_size: int = 32, min_improvement: float = 0.01, keep_last_batch: bool = False, max_trees: int = 512, **parameters) -> None:
        if tree_batch_size < 1 or max_trees < 1 or not 0 <= min_improvement < 1:
            raise ValueError("tree_batch_size and max_trees must be positive and min_improvement in [0, 1)")
        self.autogrow, self.tree_batch_size, self.min_improvement, self.keep_last_batch, self.max_trees = autogrow, tree_batch_size, min_improvement, keep_last_batch, max_trees
        self.parameters, self.sizing_, self.tree_history_ = parameters, None, []

    def _sized(self, df: DataFrame, label: str, key: str | None) -> Config:
        base = self.estimator(**self.parameters).config
        outputs = 1 if not self.estimator.classification else max(1, df.select(label).distinct().count() - 1)
        n = df.count()
        if base.bootstrap_max is None or n <= 2 * base.bootstrap_max * outputs:
            return base
        rows = [base.bootstrap_max, *(r for r in ROWS[self.autogrow] if base.bootstrap_max < r <= 0.8 * n / outputs)]
        windows = [base.max_node_samples, *(w for w in NODE_ROWS[self.autogrow] if w > base.max_node_samples)]
        trials = [Sweep(f"rows={r}", {}, base.but(bootstrap_max=r)) for r in rows] + [Sweep(f"window={w}", {}, base.but(max_node_samples=w)) for w in windows[1:]]
        self.sizing_ = {r["name"]: r["loss"] for r in screen(self.estimator(**self.parameters), df, label, trials, key=key).collect()}
        by_rows = [self.sizing_[f"rows={r}"] for r in rows]
        by_window = [by_rows[0], *(self.sizing_[f"window={w}"] for w in windows[1:])]
        return base.but(bootstrap_max=rows[justified(by_rows, self.min_improvement)], max_node_samples=windows[justified(by_window, self.min_improvement)])

    def fit(self, df: DataFrame, label: str, *, key: str | None = None) -> ForestModel:
        """An ordinary fit of the sized configuration, or with autogrow batches of trees until one pays too little.

        All batches share one pool, encoding and set of tracked rows; each has a seed of its own.
        ``tree_history_`` has for each batch the trees so far, their out-of-bag loss, its relative improvement
        (None for the first) and whether the batch was accepted.
        """
        config, estimator = self._sized(df, label, key), self.estimator(**self.parameters)
        self.tree_history_ = []
        if not self.autogrow:
            return estimator.fit_many(df, label, {0: config}, key=key)[0]
        seed, step = config.seed or 0, config.but(n_trees=min(self.tree_batch_size, self.max_trees), oob=True)
        pool = estimator.pool(df, label, [step], key=key)
        try:
            tracked = pool.tracking(TRACKED * pool.outputs, seed).persist()
            grown, last = pool.grown(step, tracked), None
            last = loss(grown)
            self.tree_history_.append({"trees": grown.n_trees_, "loss": last, "improvement": None, "accepted": True})
            while grown.n_trees_ + step.n_trees <= self.max_trees:
                both = grown.combined(pool.grown(step.but(seed=batch_seed(seed, len(self.tree_history_))), tracked))
                found = loss(both)
                improvement = (last - found) / last if last else 0.0
                accepted = improvement >= self.min_improvement
                self.tree_history_.append({"trees": both.n_trees_, "loss": found, "improvement": improvement, "accepted": accepted})
                if accepted or self.keep_last_batch:
                    grown, last = both, found
                if not accepted:
                    break
            tracked.unpersist()
            return grown
        finally:
            pool.release()


class AutoForestClassifier(AutoForest):
    """A classifier sized in the same way."""

    estimator = ForestClassifier
