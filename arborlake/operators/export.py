"""A fitted forest as one SQL expression, which any engine that reads SQL can run without this package."""

from __future__ import annotations

import numpy as np

from arborlake.operators import kernel
from arborlake.operators.forest import Feature, ForestModel, packed_trees


def _value(f: Feature) -> str:
    if f.kind == "numeric":
        return f"CAST(`{f.sources[0]}` AS DOUBLE)"
    if f.kind == "lexical":
        known = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in f.values or [])
        return f"(size(filter(array({known}), v -> v < `{f.sources[0]}`)) - CASE WHEN array_contains(array({known}), `{f.sources[0]}`) THEN 0.0 ELSE 0.5 END)"
    if f.kind == "bundle":
        whens = " ".join(f"WHEN `{c}` = 1 THEN {i}" for i, c in enumerate(f.sources, 1))
        return f"CASE {whens} ELSE 0 END"
    raise ValueError(f"{f.name!r}: forests with date parts are not exported")


def tree_sql(tree: dict[str, np.ndarray], features: list[Feature], output: int = 0, node: int = 0) -> str:
    """Nested CASE of a tree's value; missing values go to the stored side."""
    f = int(tree["feature"][node])
    if f < 0:
        return f"{float(tree['value'][node, output])!r}D"
    value, cut, left = _value(features[f]), float(tree["cut"][node]), int(tree["left"][node])
    goes_left = f"{value} {'=' if tree['kind'][node] == kernel.EQ else '<='} {cut!r}D"
    if not tree["missing_right"][node]:
        goes_left = f"({value} IS NULL OR {goes_left})"
    return f"CASE WHEN {goes_left} THEN {tree_sql(tree, features, output, left)} ELSE {tree_sql(tree, features, output, left + 1)} END"


def forest_sql(model: ForestModel, output: int = 0) -> str:
    """The mean over trees: the prediction, or the probability of class number ``output``."""
    trees = packed_trees(model.nodes)
    return "(" + " + ".join(tree_sql(t, model.encoder.features, output) for t in trees) + f") / {len(trees)}"
