"""Deterministic sampling by hashing: the same rows whatever the partitioning, and in SQL too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bits of the hash number that rows are counted by when a sample's cut is looked for.
BUCKET_BITS = 10


def hash_key(seed: int, stream: str, *keys: str | Column) -> Column:
    """32 hexadecimal digits that order rows at random: md5 of seed, stream and keys."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{stream}"), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def hash_number(key: Column) -> Column:
    """The first 32 bits of a hash key, as a long."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def sample_rows(df: DataFrame, k: int, seed: int, stream: str, key: str) -> DataFrame:
    """Exactly min(k, rows) rows without replacement: the first in the order of their hash keys.

    Rows are counted by the hash number's bucket; only the bucket that the cut falls into is sorted, and the
    sample is a filter of the table by the cut. Rows that repeat a key tie at the cut and count one by one.
    """
    keyed = df.withColumn("_order", hash_key(seed, stream, key))
    bucket = F.shiftright(hash_number(F.col("_order")), 32 - BUCKET_BITS)
    counts = dict(keyed.groupBy(bucket.alias("b")).count().collect())
    if k >= sum(counts.values()):
        return df
    before = at = 0
    for at in sorted(counts):
        if before + counts[at] >= k:
            break
        before += counts[at]
    place = F.struct("_order", F.col(key).cast("string").alias("k"))
    first = keyed.filter(bucket == at).select(place.alias("p")).orderBy("p").limit(k - before).groupBy("p").count().orderBy(F.desc("p")).limit(1).collect()
    cut = F.struct(F.lit(first[0]["p"]["_order"]).alias("_order"), F.lit(first[0]["p"]["k"]).alias("k")) if first else F.lit(None)
    below = keyed.filter((bucket < at) | ((bucket == at) & (place < cut))).drop("_order")
    if not first:
        return below
    ties = keyed.filter((bucket == at) & (place == cut))
    taken = first[0]["count"]
    return keyed.filter((bucket < at) | ((bucket == at) & (place <= cut))).drop("_order") if taken == ties.count() else below.unionByName(ties.limit(taken).drop("_order"))


def bernoulli(df: DataFrame, share: float, seed: int, stream: str, key: str) -> DataFrame:
    """Each row with this probability."""
    return df.filter(hash_number(hash_key(seed, stream, key)) < int(share * 2**32))


def split(df: DataFrame, share: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(training, validation) rows."""
    below = hash_number(hash_key(seed, "split", key)) < int(share * 2**32)
    return df.filter(below), df.filter(~below)


def split_final_rows(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all but the last n rows, the last n rows) in a total order, which n bounds: only the cut is sorted out."""
    last = df.orderBy(*(F.desc(c) for c in order)).limit(n).agg(F.min(F.struct(*order))).first()[0]
    if last is None:
        return df, df
    cut = F.struct(*(F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order))
    return df.filter(F.struct(*order) < cut), df.filter(F.struct(*order) >= cut)


def take_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is in keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def dense_index(df: DataFrame, key: str, buckets: int = 256, tasks: int | None = None) -> DataFrame:
    """df with idx, 0 to n - 1 without gaps; counts of ``buckets`` hash buckets are all that meets in one place.

    tasks: how many parts the buckets are dealt to, by default as many as the session shuffles into.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    dealt = bucketed.repartition(tasks, "_bucket") if tasks else bucketed
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1)
    return numbered.join(F.broadcast(before), "_bucket").withColumn("idx", F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def tree_draws(spark: SparkSession, trees: int, rows: int, n: int, seed: int) -> DataFrame:
    """(tree_id, draw_id, idx): rows draws with replacement from n indices for each tree."""
    drawn = spark.range(trees * rows).select((F.col("id") / rows).cast("int").alias("tree_id"), (F.col("id") % rows).alias("draw_id"))
    return drawn.withColumn("idx", hash_number(hash_key(seed, "bootstrap", "tree_id", "draw_id")) % n)


def tree_samples(spark: SparkSession, pool: DataFrame, trees: int, rows: int, n: int, seed: int, replacement: bool) -> DataFrame:
    """(tree_id, draw_id, all columns of pool, which has idx): the rows that each tree learns from.

    Multiplicity is kept: with replacement each draw is a row of its own.
    """
    rows = min(rows, n) if not replacement else rows
    if replacement:
        return tree_draws(spark, trees, rows, n, seed).join(pool, "idx")
    order = hash_key(seed, "subsample", "tree_id", "idx")
    spread = pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    if rows == n:
        return spread.withColumn("draw_id", F.col("idx"))
    share = min(1.0, (rows + 6 * rows**0.5 + 20) / n)
    some = spread.withColumn("_order", order).filter(hash_number(F.col("_order")) < int(share * 2**32))
    ranked = some.withColumn("draw_id", F.row_number().over(Window.partitionBy("tree_id").orderBy("_order", "idx")).cast("long") - 1)
    return ranked.filter(F.col("draw_id") < rows).drop("_order")


def permuted(df: DataFrame, columns: list[str], key: str, seed: int, stream: str) -> DataFrame:
    """df (a bounded sample) with the columns shuffled together over its rows."""
    place = df.withColumn("_place", F.row_number().over(Window.orderBy(key)))
    other = df.select(*columns, F.row_number().over(Window.orderBy(hash_key(seed, stream, key), key)).alias("_place"))
    return place.drop(*columns).join(other, "_place").drop("_place").select(*df.columns)
