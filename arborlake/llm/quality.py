"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Trees have a fixed depth and lie in flat arrays (feature, cut, leaf value), so a batch of documents goes
down all trees by array indexing.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm import labelled

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
NAMES = (
    "log_chars log_words upper lower digit space stop symbol bang bar wide newline mean_word longest distinct commonest repeats "
    "ends_plain all_caps lines_distinct mean_line entropy stops_per_word title block_distinct"
).split()
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:", b"#$%&*@^~<>{}=+_\\/[]()", b"!?", b"|"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
_PLAIN = re.compile(r"\w[.,;:!?]?$")


def statistics(text: str) -> list[float]:
    """NAMES' values for a text; an empty one has zeros."""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(NAMES) - 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = counts.sum()
    kinds = np.bincount(_CLASS, counts, 10) / total
    share = counts[counts > 0] / total
    n = len(words)
    by_word = Counter(words)
    lines = [x for x in text.split("\n") if x]
    blocks = [words[i : i + 200] for i in range(0, n, 200)]
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        *kinds[1:9].tolist(),
        float(kinds[9]),
        counts[10] / total,
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, words)))),
        len(by_word) / n,
        max(by_word.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c for w, c in by_word.items() if _PLAIN.search(w)) / n,
        sum(c for w, c in by_word.items() if w.isupper()) / n,
        len(set(lines)) / max(1, len(lines)),
        len(text) / max(1, len(lines)),
        float(-(share * np.log2(share)).sum()),
        counts[46] / n,
        sum(c for w, c in by_word.items() if w.istitle()) / n,
        sum(len(set(b)) / len(b) for b in blocks) / len(blocks),
    ]


class BoostedTrees:
    """Histogram boosting for a 0/1 target with logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        inner = (1 << self.depth) - 1
        self.feature, self.cut = np.zeros((self.trees, inner), np.int32), np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        prior = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(prior / (1 - prior)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1], method="lower")) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        logit = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-logit))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                many, first = 1 << level, (1 << level) - 1
                best, at, of = np.full(many, 1e-9), np.full(many, -1), np.zeros(many, np.int64)
                for f in range(width):
                    key = node * self.bins + binned[:, f]
                    G, H, C = (np.bincount(key, w, many * self.bins).reshape(many, -1).cumsum(1) for w in (g, h, None))
                    left_g, left_h, left_c = G[:, :-1], H[:, :-1], C[:, :-1]
                    all_g, all_h, all_c = G[:, -1:], H[:, -1:], C[:, -1:]
                    gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain[(left_c < self.least) | (all_c - left_c < self.least)] = -1
                    where = gain.argmax(1)
                    value = gain[np.arange(many), where]
                    better = value > best
                    best[better], at[better], of[better] = value[better], where[better], f
                for k in range(many):
                    if at[k] >= 0 and at[k] < len(edges[of[k]]):
                        self.feature[t, first + k], self.cut[t, first + k] = of[k], edges[of[k]][at[k]]
                node = 2 * node + (x[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            value = np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + self.l2)
            self.leaf[t] = self.rate * value
            logit += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        rows, logit = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            logit += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-logit))


def _features(texts: list[str]) -> list[list[float]]:
    return [statistics(t) for t in texts]


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = SAMPLE, **columns) -> BoostedTrees:
    """Learns from at most ``bound`` labelled documents outside the held-out fold; without both labels: their share."""
    rows = labelled.sample(docs, labels, label, folds=FOLDS, held_out=HELD_OUT, bound=bound, **columns)
    table = labelled.gathered(rows, lambda texts: [pa.array(_features(texts), pa.list_(pa.float64()))], {"f": "array<double>"})
    x = np.array(table["f"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    return BoostedTrees().fit(x, table["label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = SAMPLE, **columns) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Null texts score as empty ones, of any length whole texts count; null and repeated ids stay as they are
    (null: not held out); an empty table gives no rows; further columns are ignored. Labels other than 0 and
    1 are ignored; of repeated labels of a document the largest counts.
    """
    model = fit(docs, labels, label=label, bound=bound, **columns)
    return labelled.scored(docs, lambda texts: model.predict(np.array(_features(texts)).reshape(-1, len(NAMES))), folds=FOLDS, held_out=HELD_OUT, **columns)
