"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings in whole texts. Each labelled text has a
counterfactual: its identity terms are swapped for others of their group, or, if it names no group, a mention of one is
put between its words. The loss adds ``penalty`` times the mean squared change of the score's logit, so a mere
mention moves no score, whatever the labels say about mentions.

Every hashed feature may enter the model. An L1 penalty, weaker for features that differ more between the labels,
keeps few; features join the dense problem as their gradient asks for it, until none is left that does.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm import labelled
from arborlake.llm.shared import give_back, tidy

#: Labelled rows to learn from, at most.
SAMPLE = 12_000
FOLDS, HELD_OUT = 3, 1
SPACE = 1 << 20
#: Lengths of the word beginnings that are features, so that inflected and derived forms share evidence.
BEGINNINGS = (3, 4, 5)
#: Groups of terms that may stand for each other, in English, German, French and Spanish.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "hispanic", "latino", "african"),
    ("immigrant", "native", "foreigner", "refugee"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("disabled", "blind", "deaf"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgeschlechtlich"),
    ("ausländer", "einwanderer", "flüchtling", "einheimischer"),
    ("behindert", "blind", "taub"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("lesbienne", "homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("immigrés", "étrangers", "réfugiés", "autochtones"),
    ("handicapé", "aveugle", "sourd"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("lesbiana", "homosexual", "heterosexual", "bisexual", "transgénero"),
    ("inmigrantes", "extranjeros", "refugiados", "nativos"),
    ("discapacitado", "ciego", "sordo"),
)
Groups = tuple[tuple[str, ...], ...]
_WORD = re.compile(r"\w+")


def _hashed(words: set[str]) -> set[int]:
    named = words | {f"^{w[:k]}" for k in BEGINNINGS for w in words if len(w) > k}
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) & (SPACE - 1) for w in named}


def features(text: str) -> list[int]:
    return sorted(_hashed(set(_WORD.findall(text.lower()))))


def counterfactual(text: str, groups: Groups = IDENTITY) -> tuple[str, bool]:
    """(the text with each identity term swapped for the next of its group, True), or with a mention put in, False.

    The mention and its place between two words follow from the text's checksum. A term of several groups counts
    in the first. A swapped term keeps a capital letter at its start.
    """
    other = {w: group[(i + 1) % len(group)] for group in reversed(groups) for i, w in enumerate(group)}

    def swap(m: re.Match) -> str:
        new = other.get(m[0].lower(), m[0])
        return new.capitalize() if m[0][:1].isupper() and new != m[0] else new

    swapped = _WORD.sub(swap, text)
    if swapped != text:
        return swapped, True
    terms = sorted(other)
    if not terms:
        return text, False
    crc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    words = list(_WORD.finditer(text))
    at = words[crc % len(words)].end() if words else 0
    return f"{text[:at]} {terms[crc // 7 % len(terms)]}{' ' if not words else ''}{text[at:]}", False


def _examples(texts: list[str], groups: Groups) -> list[pa.Array]:
    """Of each text its features, those that its counterfactual adds and lacks, and whether that is a swap."""
    found, added, lacked, swaps = [], [], [], []
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        mine = _hashed(words)
        other, swap = counterfactual(text, groups)
        after = set(_WORD.findall(other.lower()))
        found.append(sorted(mine))
        added.append(sorted(_hashed(after - words) - mine))
        lacked.append(sorted(mine - _hashed(after)) if words - after else [])
        swaps.append(swap)
    return [_lists(found), _lists(added), _lists(lacked), pa.array(swaps, pa.bool_())]


def _flat(lists: pa.ListArray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each entry of these rows' lists."""
    offsets = lists.offsets.to_numpy()[first : last + 1].astype(np.int64)
    rows = np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets))
    return rows, lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)


class Model:
    """Sparse logistic regression on hashed features; weight is an array over the whole hash space.

    ``pairs`` and ``swaps`` say how many counterfactuals changed a feature, and how many of them by swapping.
    Without any, as without identity groups, the penalty has no effect and the model is the plain one.
    """

    def __init__(self, penalty: float = 10.0, l1: float = 0.003, steps: int = 300, most: int = 200) -> None:
        self.penalty, self.l1, self.steps, self.most = penalty, l1, steps, most
        self.weight, self.bias, self.pairs, self.swaps = np.zeros(SPACE, np.float32), 0.0, 0, 0

    def fit(self, found: pa.ListArray, added: pa.ListArray, lacked: pa.ListArray, y: np.ndarray, swapped: np.ndarray | None = None) -> Model:
        """Learns from each text's features and what its counterfactual adds and lacks, as lists of int32."""
        n, positive = len(y), float(y.sum())
        self.bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
        if not 0 < positive < n:
            return self
        changed = (np.diff(added.offsets.to_numpy()) > 0) | (np.diff(lacked.offsets.to_numpy()) > 0)
        self.pairs, self.swaps = int(changed.sum()), int((changed & swapped).sum()) if swapped is not None else 0
        share = np.where(y > 0, min(5.0, (n - positive) / positive), 1.0).astype(np.float32)
        share /= share.sum()
        pull = 2 * self.penalty / max(1, self.pairs)

        def summed(lists: pa.ListArray, value: np.ndarray) -> np.ndarray:
            out = np.zeros(SPACE, np.float32)
            for some in range(0, n, 500):
                row, flat = _flat(lists, some, some + 500)
                out += np.bincount(flat, value[row], SPACE)
            return out

        def dense(lists: pa.ListArray, place: np.ndarray, width: int) -> np.ndarray:
            out = np.zeros((n, width), np.float32)
            for some in range(0, n, 500):
                row, flat = _flat(lists, some, some + 500)
                at = place[flat]
                out[row[at >= 0], at[at >= 0]] = 1
            return out

        expected = summed(found, np.full(n, positive / n))
        cost = 1 / np.maximum(np.abs(summed(found, y) - expected) / np.sqrt(np.maximum(expected * (1 - positive / n), 1e-9)), 1e-3)
        error, drift = share * (1 / (1 + np.exp(-self.bias)) - y), np.zeros(n, np.float32)
        weight, bias, active = np.zeros(SPACE, np.float32), self.bias, np.zeros(0, np.int64)
        cost *= self.l1 * 4.5 * np.abs(summed(found, error)).max()
        while True:
            slope = summed(found, error) + pull * (summed(added, drift) - summed(lacked, drift))
            fresh = np.setdiff1d(np.flatnonzero(np.abs(slope) > 1.01 * cost), active)
            if not len(fresh):
                break
            fresh = fresh[np.argsort(-np.abs(slope[fresh]) / cost[fresh], kind="stable")][: self.most]
            active = np.concatenate([active, fresh])
            place = np.full(SPACE, -1, np.int32)
            place[active] = np.arange(len(active))
            x = dense(found, place, len(active))
            change = dense(added, place, len(active)) - dense(lacked, place, len(active))
            w, bias = self._shrunk(x, change, y, share, pull, weight[active], bias, cost[active])
            weight[active] = w
            error, drift = share * (1 / (1 + np.exp(-(x @ w + bias))) - y), change @ w
        self.weight, self.bias = weight, float(bias)
        return self

    def _shrunk(self, x: np.ndarray, change: np.ndarray, y: np.ndarray, share: np.ndarray, pull: float, w: np.ndarray, b: float, cost: np.ndarray) -> tuple[np.ndarray, float]:
        """The weights of least loss, by accelerated proximal steps."""
        v = np.ones(x.shape[1] + 1, np.float32)
        for _ in range(20):  # the curvature's largest eigenvalue
            u = share * (x @ v[:-1] + v[-1])
            v = np.append(0.25 * (x.T @ u) + pull * (change.T @ (change @ v[:-1])), 0.25 * u.sum()).astype(np.float32)
            steep = float(np.linalg.norm(v))
            v /= steep
        rate, w = 1 / (1.1 * steep), w.astype(np.float32)
        ahead, ahead_b, speed = w, b, 1.0
        for _ in range(self.steps):
            e = share * (1 / (1 + np.exp(-(x @ ahead + ahead_b))) - y)
            slope = x.T @ e + pull * (change.T @ (change @ ahead))
            to = ahead - rate * slope
            to = np.sign(to) * np.maximum(np.abs(to) - rate * cost, 0).astype(np.float32)
            to_b = ahead_b - rate * float(e.sum())
            faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            moved = float(np.abs(to - w).max())
            ahead, ahead_b = to + (speed - 1) / faster * (to - w), to_b + (speed - 1) / faster * (to_b - b)
            w, b, speed = to, to_b, faster
            if moved < 1e-4:
                break
        return w, b

    def predict(self, texts: list[str]) -> np.ndarray:
        logit = [self.weight[np.array(features(t), np.int64)].sum(dtype=np.float64) + self.bias for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(logit, np.float64), -50, 50)))


def _lists(found: list[list[int]]) -> pa.ListArray:
    return pa.array(found, pa.list_(pa.int32()))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = SAMPLE, penalty: float = 10.0, groups: Groups = IDENTITY, **columns) -> Model:
    """Learns from at most ``bound`` labelled documents outside the held-out fold; without both labels: their share.

    Long texts count whole. Without identity groups there are no pairs and the model is the plain one.
    """
    rows = labelled.sample(docs, labels, label, folds=FOLDS, held_out=HELD_OUT, bound=bound, **columns)
    table = labelled.gathered(rows, lambda texts: _examples(texts, groups), {"found": "array<int>", "added": "array<int>", "lacked": "array<int>", "swap": "boolean"})
    found, added, lacked = (table[c].combine_chunks() if table.num_rows else _lists([]) for c in ("found", "added", "lacked"))
    model = Model(penalty).fit(found, added, lacked, table["label"].to_numpy().astype(np.float32), table["swap"].to_numpy().astype(bool))
    del table, found, added, lacked
    give_back()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = SAMPLE, penalty: float = 10.0, groups: Groups = IDENTITY, **columns) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Null texts score as empty ones; null and repeated ids stay as they are (null: not held out); an empty
    table gives no rows; further columns are ignored. Labels other than 0 and 1 are ignored; of repeated
    labels of a document the largest counts.
    """
    model = fit(docs, labels, label=label, bound=bound, penalty=penalty, groups=groups, **columns)
    return labelled.scored(docs, model.predict, folds=FOLDS, held_out=HELD_OUT, **columns)


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, label: str = "toxic", bound: int = SAMPLE, text_column: str = "text", **columns) -> DataFrame:
    """docs without the rows whose text scores ``threshold`` or more; all columns and all other rows stay."""
    model = fit(docs, labels, label=label, bound=bound, text_column=text_column, **columns)

    def run(batches):
        for batch in batches:
            score = model.predict([t or "" for t in batch.column(batch.schema.get_field_index(text_column)).to_pylist()])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
