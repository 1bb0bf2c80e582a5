"""Packs token sequences into windows by multiway Karmarkar-Karp differencing.

Each task packs the documents of its partition, ``group`` at a time, so memory is bounded and nothing is
shuffled; many small partitions are packed by few tasks, for windows are near-equal within a group only. A document longer than a window gives whole windows first; what remains of each document is an
item. Differencing starts from one partial partition an item, merges the two with the largest imbalance,
pairing the heavier subsets of one with the lighter ones of the other, and ends with near-equal windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.encoder import encoder
from arborlake.llm.shared import importable, pieces, tasks_for, tidy

SCHEMA = "{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, so that the windows' sums are nearly equal."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def subsets(node: int) -> np.ndarray:
        if node in sums:
            return sums.pop(node)
        leaf = np.zeros(k, np.int64)
        leaf[0] = sizes[node]
        return leaf

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = subsets(a) + subsets(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    window = np.zeros(n, np.int64)
    labels = {n + len(merges) - 1: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        here = labels.pop(n + i)
        back = np.empty(k, np.int64)
        back[order] = here
        for node, of in ((a, back), (b, back[::-1])):
            if node < n:
                window[node] = of[0]
            else:
                labels[node] = of
    return window


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows) for items of 1 to capacity tokens.

    The window count starts at the least possible one and rises whenever a window exceeds the capacity: to
    where windows as unequal as the last ones would fit, and by growing steps at least. Then the count in
    between is halved down, so the result fits and one window less does not. Nothing is cut.
    """
    total = int(sizes.sum())
    k, over, step = max(1, -(-total // capacity)), 0, 1
    while (top := int(np.bincount(window := differencing(sizes, k), sizes).max())) > capacity:
        over = k
        k = min(len(sizes), max(k + step, -(-total // max(1, capacity - (top - total // k)))))
        step *= 2
    while over and k - over > 1:
        some = differencing(sizes, (k + over) // 2)
        if np.bincount(some, sizes).max() > capacity:
            over = (k + over) // 2
        else:
            k, window = (k + over) // 2, some
    return window, k


def _packed(docs: list, capacity: int, first: int, rows: list) -> int:
    """Adds the pieces of docs [(doc_id, ids)] to rows; returns the next free sequence."""
    sizes, of = [], []

    def add(doc: int, start: int, length: int, sequence: int, offset: int) -> None:
        key, ids = docs[doc]
        rows.append((key, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), sequence, offset))

    for d, (_, ids) in enumerate(docs):
        whole = len(ids) // capacity
        for j in range(whole):
            add(d, j * capacity, capacity, first, 0)
            first += 1
        if rest := len(ids) - whole * capacity:
            sizes.append(rest)
            of.append((d, whole * capacity))
    if not sizes:
        return first
    window, k = pack(np.array(sizes, np.int64), capacity)
    offset = np.zeros(k, np.int64)
    for item in np.argsort(window, kind="stable"):
        (d, base), w = of[item], window[item]
        add(d, base, sizes[item], first + int(w), int(offset[w]))
        offset[w] += sizes[item]
    return first + k


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, end_id: int = 2, group: int = 2048
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` ids.

    Null and empty texts are the end id alone; rows with a null or repeated id are documents of their own,
    and a null id stays null; an empty table gives no rows; further columns are ignored. sequence_id is
    unique over the whole result: the partition's number in the high bits, as in
    monotonically_increasing_id(). Only documents longer than a sequence are cut. The result depends on how rows are dealt to partitions, never on timing.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, first = encoder(tokenizer).encode, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held, tokens, rows = [], 0, []

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in pieces(texts, 1_000_000):
                ids, lengths = encode(texts[part])
                till = np.cumsum(lengths)
                for key, n, e in zip(keys[part], lengths, till, strict=True):
                    held.append((key, np.append(ids[e - n : e], np.uint32(end_id))))
                    tokens += int(n)
                    if len(held) >= group or tokens > 8_000_000:
                        first = _packed(held, capacity, first, rows)
                        held, tokens = [], 0
                        yield made()
                        rows = []
        if held:
            _packed(held, capacity, first, rows)
            yield made()

    return docs.select(id_column, text_column).coalesce(tasks_for(docs)).mapInArrow(tidy(run), SCHEMA.format(id=id_column))
