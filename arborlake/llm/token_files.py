"""Token ids in binary files: encoded in ascending id order, range-coded in blocks, and read back.

A file is a row of frames, each followed by a line feed. A frame holds whole documents: its place (part,
frame, ids of the part before it), their ids and lengths, and blocks of :mod:`arborlake.llm.coder`, each
with its own model and checksums. So a damaged block costs one frame, and frames can be read in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm import coder
from arborlake.llm.encoder import encoder
from arborlake.llm.shared import importable, new_path, slices, stored, tidy

FRAME = struct.Struct("<4sQIIQII")
MAGIC = b"TKF1"
#: Stretches kept by one worker.
KEPT = 1_000_000
#: Ids of a block, and about the ids of a frame.
BLOCK = 1 << 21


def frame(part: int, number: int, before: int, keys: list, arrays: list[np.ndarray]) -> bytes:
    counts = np.array([len(a) for a in arrays], "<u8")
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    blocks = [coder.encode(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    head = np.array([k or 0 for k in keys], "<i8").tobytes() + bytes(k is None for k in keys) + counts.tobytes()
    body = head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)
    return FRAME.pack(MAGIC, FRAME.size + len(body), part, number, before, len(keys), len(blocks)) + body


def frames(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(part, ids before it in the part, document ids, counts, token ids) of each frame of a file."""
    at = 0
    while at < len(content):
        magic, length, part, _, before, n, blocks = FRAME.unpack_from(content, at)
        if magic != MAGIC or at + length > len(content):
            raise ValueError("damaged frame")
        head_at, head_size = at + FRAME.size, 17 * n
        head = content[head_at : head_at + head_size]
        if zlib.crc32(head) != struct.unpack_from("<I", content, head_at + head_size)[0]:
            raise ValueError("damaged frame")
        void = head[8 * n : 9 * n]
        keys = [None if v else k for k, v in zip(np.frombuffer(head, "<i8", n).tolist(), void, strict=True)]
        counts = np.frombuffer(head, "<u8", n, 9 * n).astype(np.int64)
        ids, b = [np.zeros(0, np.uint32)], head_at + head_size + 4
        for _ in range(blocks):
            size = coder.HEAD.size + coder.HEAD.unpack_from(content, b)[4]
            ids.append(coder.decode(content[b : b + size]))
            b += size
        yield part, before, keys, counts, np.concatenate(ids)
        at += length + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2) -> None:
    """Writes the ids of all documents, in ascending order of their id, under path.

    Null and empty texts are the end id alone. Null ids come first; documents with equal ids are in order of
    their text. An empty table gives no frames. Further columns are ignored.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0, 0
        encode, keys, arrays, held = encoder(tokenizer, kept=KEPT).encode_column, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(part, number, before, keys, arrays)], pa.binary())], ["frame"])

        for batch in batches:
            some, texts = batch.column(0).to_pylist(), batch.column(1)
            for cut in slices(pc.binary_length(texts).fill_null(0).to_pylist(), 4_000_000):
                ids, lengths = encode(texts[cut.start : cut.stop])
                for key, n, e in zip(some[cut], lengths, np.cumsum(lengths), strict=True):
                    if held and held + n + 1 > BLOCK:
                        yield made()
                        number, before, held, keys, arrays = number + 1, before + held, 0, [], []
                    keys.append(key)
                    arrays.append(np.append(ids[e - n : e], np.uint32(end_id)))
                    held += int(n) + 1
        if keys:
            yield made()

    ordered = docs.select(F.col(id_column).cast("long").alias("k"), F.col(text_column).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    coded = ordered.mapInArrow(tidy(run), "frame binary")
    coded.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 16).text(path)


def read_tokens(spark: SparkSession, path: str, *, id_column: str = "doc_id") -> DataFrame:
    """A row for each document in the files under path: its place, length, and crc32 of its ids as read."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_column, "part", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for i in range(batch.num_rows):
                for part, before, keys, counts, ids in frames(batch.column(0)[i].as_py()):
                    till = np.cumsum(counts)
                    raw = ids.astype("<u4")
                    crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(till, counts, strict=True)]
                    rows = (keys, [part] * len(keys), before + till - counts, counts, crc)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(run), f"{id_column} long, part long, start long, n_tokens long, ids_crc32 long")


def placed(read: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """start counted over all parts; the running sum is over one row a part."""
    read = stored(read, "token-index")
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    whole = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return read.join(whole, "part").select(id_column, (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, tokenizer: str, **columns) -> DataFrame:
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **columns)
    return placed(read_tokens(docs.sparkSession, path, id_column=columns.get("id_column", "doc_id")), id_column=columns.get("id_column", "doc_id"))
