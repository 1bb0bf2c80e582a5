"""Tokens of whole documents, attributed to their sections by character offsets.

Each document is encoded once. Its sections' character ranges tile it; each token's character span is
joined to the sections that it meets (both are sorted, so one merge a document), and a token that crosses
a boundary goes where ``rule`` says:

- "start": to the section of its first character;
- "majority": to the section with most of its characters, of equal ones to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.encoder import encoder
from arborlake.llm.shared import importable, pieces, tidy

RULES = ("start", "majority")


def sections(text: str, separator: str) -> np.ndarray:
    """Where sections begin, then the text's length: a section ends with its separator. Empty: one section."""
    cuts, at = [0], text.find(separator)
    while at >= 0:
        at += len(separator)
        if at < len(text):
            cuts.append(at)
        at = text.find(separator, at)
    return np.array([*cuts, len(text)], np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, those of them that cross a boundary) for token spans in ascending order."""
    n = len(cuts) - 1
    first = np.clip(np.searchsorted(cuts, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(cuts, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    crosses = last > first
    home = first.copy()
    if rule == "majority":
        for i in np.nonzero(crosses)[0]:
            s = np.arange(first[i], last[i] + 1)
            home[i] = s[np.argmax(np.minimum(cuts[s + 1], ends[i]) - np.maximum(cuts[s], starts[i]))]
    return np.bincount(home, minlength=n), np.bincount(home[crosses], minlength=n)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", separator: str = "\n", rule: str = "start") -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing) for each section of each document.

    Null and empty texts give one empty section without tokens; null and repeated ids stay as they are; an
    empty table gives no rows; further columns are ignored. The sums over a document are its token count.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    importable(docs.sparkSession)
    names = [id_column, "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, offsets=True).encode
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for cut in pieces(texts, 2_000_000):
                _, lengths, starts, ends = encode(texts[cut])
                till, many, rows = np.cumsum(lengths), [], []
                for text, e, n in zip(texts[cut], till, lengths, strict=True):
                    cuts = sections(text, separator)
                    n_tokens, n_crossing = attribute(starts[e - n : e], ends[e - n : e], cuts, rule)
                    many.append(len(n_tokens))
                    rows.append((np.arange(len(n_tokens)), cuts[:-1], cuts[1:], n_tokens, n_crossing))
                at = np.repeat(np.arange(cut.start, cut.stop), many)
                columns = [np.concatenate(c).astype(np.int64) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *map(pa.array, columns)], names)

    kept = docs.select(docs[id_column].cast("long").alias(id_column), text_column)
    return kept.mapInArrow(tidy(run), f"{id_column} long, section long, start long, `end` long, n_tokens long, n_crossing long")
