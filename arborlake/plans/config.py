"""Hyper-parameters, their checks, and how many rows and trees a fit takes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    n_trees: int | None = None
    min_node_size: int = 8
    bootstrap_fraction: float | None = None
    bootstrap_max: int | None = 40_000
    replacement: bool | None = None
    max_node_samples: int = 320
    split_prior_rows: float = 3.0
    class_weight_power: float = 0.75
    cutoff_divisor: float = 10.0
    random_splitter: bool = False
    max_features: float | str = 0.9
    seed: int | None = None
    oob: bool = False
    missing_values: dict | list | None = None
    date_columns: dict | None = None
    allow_new_missing: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def checked(self) -> Config:
        """self; ValueError names the first parameter that is out of range."""
        if self.n_trees is not None and self.n_trees < 1:
            raise ValueError("n_trees must be greater than zero")
        if self.min_node_size < 2:
            raise ValueError("min_node_size must be at least 2")
        if self.max_node_samples < 2:
            raise ValueError("max_node_samples must be at least 2")
        if self.bootstrap_max is not None and self.bootstrap_max < 1:
            raise ValueError("bootstrap_max must be greater than zero")
        if self.bootstrap_fraction is not None and (not math.isfinite(self.bootstrap_fraction) or self.bootstrap_fraction <= 0):
            raise ValueError("bootstrap_fraction must be finite and greater than zero")
        if self.bootstrap_fraction is not None and self.bootstrap_fraction > 1 and self.replacement is False:
            raise ValueError("bootstrap_fraction cannot exceed 1 without replacement")
        if not math.isfinite(self.split_prior_rows) or self.split_prior_rows < 0:
            raise ValueError("split_prior_rows must be finite and non-negative")
        if not 0 <= self.class_weight_power <= 1:
            raise ValueError("class_weight_power must be between 0 and 1")
        if not math.isfinite(self.cutoff_divisor) or self.cutoff_divisor <= 0:
            raise ValueError("cutoff_divisor must be finite and greater than zero")
        if isinstance(self.max_features, str):
            if self.max_features != "sqrt":
                raise ValueError("max_features must be 'sqrt' or a fraction in (0, 1]")
        elif not 0 < self.max_features <= 1:
            raise ValueError("max_features must be 'sqrt' or a fraction in (0, 1]")
        return self

    def but(self, **changes) -> Config:
        return replace(self, **changes)


def features_per_node(max_features: float | str, p: int) -> int:
    return max(1, math.isqrt(p) if max_features == "sqrt" else min(p, math.floor(p * max_features)))


def resolve_replacement(replacement: bool | None, n: int, classification: bool) -> bool:
    """Given, or True for small tables: below 10,000 rows, 40,000 for classes."""
    return n < (40_000 if classification else 10_000) if replacement is None else replacement


@dataclass(frozen=True)
class FitPlan:
    n_trees: int
    rows_per_tree: int
    pool_rows: int


def plan_fit(n: int, config: Config, outputs: int = 1) -> FitPlan:
    """Trees, rows of each, and rows of the pool that is preprocessed at all."""
    fraction = config.bootstrap_fraction if config.bootstrap_fraction is not None else 0.8 if config.oob else 1.0
    rows = max(1, math.floor(n * fraction))
    if config.bootstrap_max is not None:
        rows = min(rows, config.bootstrap_max * max(1, outputs))
    trees = config.n_trees or min(64, max(32, -(-2_000_000 // rows)))
    return FitPlan(trees, rows, min(n, math.ceil(round(0.63 * trees * rows, 6))))
