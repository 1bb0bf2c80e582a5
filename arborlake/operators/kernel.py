"""Grows one tree on one bounded sample in numpy, all nodes of a level at once.

A fit caps the rows of a tree (``bootstrap_max``), so a tree fits one task; trees are what is distributed.
For uncapped samples see :mod:`arborlake.operators.grow`, which distributes each level.
"""

from __future__ import annotations

import numpy as np

LE, LE_MISSING_LEFT, EQ = 0, 1, 2


class Task:
    """Sums and scores of a target: regression, or classification with class weights."""

    def __init__(self, y: np.ndarray, classes: int, prior: float, power: float) -> None:
        self.classes, self.prior = classes, prior
        if classes:
            share = np.bincount(y, minlength=classes) / max(1, len(y))
            raw = np.where(share > 0, np.maximum(share, 1e-300) ** -power, 0)
            self.weight = raw / (share * raw).sum()
            self.stats = np.zeros((len(y), classes + 1))
            self.stats[np.arange(len(y)), 1 + y] = 1
        else:
            y = y.astype(np.float64)
            self.stats = np.stack([np.ones(len(y)), y, y * y], 1)
        self.stats[:, 0] = 1

    def value(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, 1:] / sums[:, :1] if self.classes else sums[:, 1] / sums[:, 0]

    def _side(self, s: np.ndarray, mean: np.ndarray) -> np.ndarray:
        n = np.maximum(s[:, 0], 1)
        m = s[:, 1] / n
        variance = np.where(s[:, 0] > 1, np.maximum(0, (s[:, 2] - s[:, 1] * m) / np.maximum(n - 1, 1)), 0)
        pull = (self.prior / (n + self.prior)) ** 2 * (m - mean) ** 2 if self.prior else 0
        return -np.sqrt(variance + pull) * s[:, 0]

    @staticmethod
    def _term(m: np.ndarray) -> np.ndarray:
        return m * np.log(np.maximum(m, 1e-300))

    def score(self, left: np.ndarray, all_rows: np.ndarray) -> np.ndarray:
        """Score of splits with these sums on the left; left = 0 gives the node's own score."""
        right = all_rows - left
        if not self.classes:
            mean = all_rows[:, 1] / all_rows[:, 0]
            return (self._side(left, mean) + self._side(right, mean)) / all_rows[:, 0]
        out = 0.0
        for side in (left, right):
            m = np.maximum(side[:, 1:], 0) * self.weight
            out = out + self._term(m).sum(1) - self._term(m.sum(1))
        return out / np.maximum((all_rows[:, 1:] * self.weight).sum(1), 1e-300)

    def same(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Nodes whose targets are all equal."""
        if self.classes:
            return sums[:, 1:].max(1) == sums[:, 0]
        return high - low <= 1e-8 + 1e-5 * np.abs(low)


def _grouped(key: np.ndarray, stats: np.ndarray, many: int) -> np.ndarray:
    return np.stack([np.bincount(key, stats[:, c], many) for c in range(stats.shape[1])], 1)


def grow_tree(ranks: np.ndarray, y: np.ndarray, cardinality: np.ndarray, *, classes: int, features: int, min_node: int, window: int, prior: float, power: float, random_splitter: bool, divisor: float, seed: int) -> dict[str, np.ndarray]:
    """Node arrays of a tree on ranks (rows x features; a missing value's rank is the cardinality)."""
    rng = np.random.default_rng(seed)
    n, p = ranks.shape
    task = Task(y, classes, prior, power)
    target = y.astype(np.float64)
    nodes: dict[str, list] = {k: [] for k in ("feature", "kind", "cut", "missing_right", "left", "n", "gain", "depth", "value")}

    def add(many: int, sums: np.ndarray, depth: int) -> None:
        for k, v in (("feature", -1), ("kind", 0), ("cut", 0), ("missing_right", True), ("left", -1), ("gain", 0.0)):
            nodes[k] += [v] * many
        nodes["n"] += sums[:, 0].tolist()
        nodes["depth"] += [depth] * many
        nodes["value"] += list(task.value(sums))

    order = rng.permutation(n)
    node = np.zeros(n, np.int64)
    add(1, task.stats.sum(0, keepdims=True), 0)
    active, first, depth = np.arange(n)[order], 0, 0
    many = 1
    while len(active) and p:
        here = node[active] - first
        count = np.bincount(here, minlength=many)
        at = np.argsort(here, kind="stable")
        active, here = active[at], here[at]
        place = np.arange(len(active)) - np.repeat(np.cumsum(count) - count, count)
        start = (rng.random(many) * np.maximum(1, count - window + 1)).astype(np.int64)[here]
        inside = (place >= start) & (place < start + window)
        rows, of = active[inside], here[inside]
        sums = _grouped(of, task.stats[rows], many)
        low, high = np.full(many, np.inf), np.full(many, -np.inf)
        np.minimum.at(low, of, target[rows])
        np.maximum.at(high, of, target[rows])
        growing = (count >= min_node) & (sums[:, 0] > 1) & ~task.same(sums, low, high)
        parent = task.score(np.zeros_like(sums), np.where(sums[:, :1] > 0, sums, 1))
        best = np.where(growing, parent + 1e-12, np.inf)
        pick = {k: np.full(many, -1, np.int64) for k in ("feature", "kind", "cut")}
        pick["missing_right"] = np.ones(many, np.int64)
        chosen = np.zeros((many, p), bool)
        draws = rng.random((many, p)).argsort(1)[:, :features]
        chosen[np.arange(many)[:, None], draws] = True
        chosen &= growing[:, None]
        for f in range(p):
            use = chosen[of, f]
            if not use.any():
                continue
            r, o, s = ranks[rows[use], f], of[use], task.stats[rows[use]]
            key = o * (int(cardinality[f]) + 1) + r
            runs, inverse = np.unique(key, return_inverse=True)
            bins = _grouped(inverse, s, len(runs))
            own, rank = np.divmod(runs, int(cardinality[f]) + 1)
            head = np.searchsorted(own, own, "left")
            total = np.concatenate([np.zeros((1, bins.shape[1])), np.cumsum(bins, 0)])
            left = total[1:] - total[head]
            tail = np.searchsorted(own, own, "right")
            whole = total[tail] - total[head]
            missing = rank == cardinality[f]
            lost = np.zeros_like(bins)
            has = np.zeros(len(runs), bool)
            ends = tail - 1
            has[missing[ends]] = True
            lost[has] = bins[ends[has]]
            final = np.arange(len(runs)) == ends - has
            candidates = [(LE, ~missing & (~final | has), left), (LE_MISSING_LEFT, ~missing & ~final & has, left + lost), (EQ, ~missing & (rank > 0) & (rank + 1 < cardinality[f]) & (bins[:, 0] < whole[:, 0]), bins)]
            if random_splitter:
                keep = rng.random(len(runs)) < np.maximum(4, count[own] * np.sqrt(features) / divisor) / np.maximum(1, count[own] * features)
                keep |= rng.random(len(runs)) < 4 / np.maximum(1, tail - head)
                candidates = [(k, ok & keep, side) for k, ok, side in candidates if k != EQ]
            for kind, ok, side in candidates:
                ok = ok & (side[:, 0] > 0) & (side[:, 0] < whole[:, 0])
                if not ok.any():
                    continue
                score, owner = task.score(side[ok], whole[ok]), own[ok]
                top = np.lexsort((rank[ok], -score, owner))
                one = top[np.unique(owner[top], return_index=True)[1]]
                better = score[one] > best[owner[one]]
                win, at_node = one[better], owner[one[better]]
                best[at_node] = score[win]
                pick["feature"][at_node], pick["kind"][at_node], pick["cut"][at_node] = f, kind, rank[ok][win]
                to_right = np.ones(len(win), np.int64) if kind == LE else np.zeros(len(win), np.int64)
                none = ~has[ok][win]
                if kind == EQ:
                    to_right = np.ones(len(win), np.int64)
                larger = (whole[ok][win, 0] - side[ok][win, 0]) >= side[ok][win, 0]
                pick["missing_right"][at_node] = np.where(none, larger, to_right)
        splits = np.nonzero(pick["feature"] >= 0)[0]
        going = np.isin(here, splits)
        active, here = active[going], here[going]
        f, cut, kind = pick["feature"][here], pick["cut"][here], pick["kind"][here]
        value = ranks[active, f]
        right = np.where(value == cardinality[f], pick["missing_right"][here] == 1, np.where(kind == EQ, value != cut, value > cut))
        # a split of the window may leave one side of all rows empty only if the window was all rows; it never does
        child = np.full(many, -1)
        next_first = len(nodes["n"])
        child[splits] = next_first + 2 * np.arange(len(splits))
        for k in splits:
            i = first + k
            nodes["feature"][i], nodes["kind"][i], nodes["cut"][i] = int(pick["feature"][k]), int(pick["kind"][k]), int(pick["cut"][k])
            nodes["missing_right"][i], nodes["left"][i], nodes["gain"][i] = bool(pick["missing_right"][k]), int(child[k]), float(max(0.0, best[k] - parent[k]))
        node[active] = child[here] + right
        first, depth, many = next_first, depth + 1, 2 * len(splits)
        if not many:
            break
        add(many, _grouped(node[active] - first, task.stats[active], many), depth)
    out = {k: np.array(v) for k, v in nodes.items() if k != "value"}
    out["value"] = np.array(nodes["value"], np.float64)
    return out


def leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each row of native values (missing: NaN); tree has native cuts."""
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x))[tree["feature"][at] >= 0]
    while len(going):
        here = at[going]
        value, cut, kind = x[going, tree["feature"][here]], tree["cut"][here], tree["kind"][here]
        right = np.where(np.isnan(value), tree["missing_right"][here], np.where(kind == EQ, value != cut, value > cut))
        at[going] = tree["left"][here] + right
        going = going[tree["feature"][at[going]] >= 0]
    return at


def contributions(tree: dict[str, np.ndarray], x: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """(root value, per row and feature the change of value along its path)."""
    out = np.zeros((len(x), width))
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x))[tree["feature"][at] >= 0]
    while len(going):
        here = at[going]
        f = tree["feature"][here]
        value, cut, kind = x[going, f], tree["cut"][here], tree["kind"][here]
        right = np.where(np.isnan(value), tree["missing_right"][here], np.where(kind == EQ, value != cut, value > cut))
        at[going] = tree["left"][here] + right
        out[going, f] += tree["value"][at[going]] - tree["value"][here]
        going = going[tree["feature"][at[going]] >= 0]
    return float(tree["value"][0]), out
