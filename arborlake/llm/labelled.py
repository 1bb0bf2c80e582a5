"""What the two classifiers share: the bounded labelled sample and scoring whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import importable, tidy


def fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, bound: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(_id, label, text) of at most ``bound`` labelled documents outside the held-out fold, in hash order.

    The bound makes the sample fit to be broadcast: bound rows of 16 bytes. Of rows that repeat an id the one
    of the least text is taken, so what reaches the driver keeps to the bound.
    """
    usable = labels.select(F.col(id_column).cast("long").alias("_id"), F.col(label).cast("int").alias("label")).filter("_id IS NOT NULL AND label IN (0, 1)")
    usable = usable.filter(fold("_id", folds) != held_out).groupBy("_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    found = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(text_column, F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id", "label").agg(F.min("text").alias("text"))


def gathered(rows: DataFrame, features: Callable[[list[str]], list[pa.Array]], kinds: dict[str, str]) -> pa.Table:
    """(_id, label and the columns of ``kinds``, which features gives for the texts) of a bounded sample, by id."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), *made], ["_id", "label", *kinds])

    schema = ", ".join(["_id long, label int", *(f"{name} {kind}" for name, kind in kinds.items())])
    return rows.mapInArrow(tidy(run), schema).toArrow().sort_by("_id")


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], *, folds: int, held_out: int, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs; null texts score as empty ones."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(found, np.float64))], [id_column, "score"])

    out = docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(tidy(run), f"{id_column} long, score double")
    return out.select(id_column, F.coalesce(fold(id_column, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
