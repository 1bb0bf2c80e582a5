"""SimHash near-duplicates: fingerprints, links within a Hamming distance, and their components.

Links are found by the generalised pigeonhole principle. Bits are grouped into partitions, correlated bits
together; thresholds of the partitions sum to ``distance - partitions + 1``, so two fingerprints within the
distance agree within its threshold on some partition. Partitions and thresholds (-1: not probed) come from
a dynamic program over expected candidate counts, which rest on the bits of all distinct fingerprints.

Equal fingerprints are one node from the start. Nodes that share a probe are compared in blocks of bounded
size: a crowded probe is split and each pair of its blocks is a group of its own. A group gives a spanning
forest of its links, not all pairs; the components are those of all links.

``keep_one``, the pipeline's stage, asks for a Jaccard similarity of shingle sets. It links fingerprints in the
same way, within a wider distance, and verifies the links on whole sets. Fingerprints alone do not give all
pairs: at 0.8 they differ in 9 of 64 bits in the middle and in many more at the tail. So an exact check follows
for what is left: the sets themselves are joined by prefix filtering, which loses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.shared import give_back_driver, importable, joined, pieces, stored, tidy

BITS = 64
#: Fingerprints of a block; two blocks meet in one group at most.
BLOCK = 2048
#: Common shingles that are told apart, at most.
COMMON = 200_000
#: Bits in which the fingerprints of the first pass's links differ at most, where a similarity is asked for.
DISTANCE = 6
#: Shared shingles of a node's prefix by which the first pass links neighbours; the second pass takes all.
SPREAD = 12
#: Bits of the sketch of a shingle set.
SKETCH = 1024
#: Links whose components the pipeline's stage finds in one task, at most; more of them take rounds.
FEW = 100_000
#: Seconds that a probe row and a compared pair take, in proportion.
PROBE, PAIR = 2e-6, 5e-9


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The hashes of all shingles, as they come; a text with fewer words has one of all its words, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    n = max(1, len(words) - shingle + 1)
    last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], seed) for a, b in zip(begin[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half the shingles' hashes; no words: 0."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, for each row."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_column, "fp"])

    return docs.select(docs[id_column].cast("long").alias(id_column), text_column).mapInArrow(tidy(run), f"{id_column} long, fp long")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How often each two bits are 1 together in fp: 64 x 64 sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            for at in range(0, len(bits), 65_536):
                total += np.rint(bits[at : at + 65_536].T @ bits[at : at + 65_536]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "c"])

    by = nodes.select("fp").mapInArrow(tidy(run), "i int, c array<long>").groupBy("i").agg(*(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(BITS)))
    out = np.zeros((BITS, BITS))
    for row in by.collect():
        out[row[0]] = [x or 0 for x in row[1:]]
    return out


def plan(counts: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest partitioning for n fingerprints with these bit counts."""
    n = max(n, 1)
    p = np.clip(np.diag(counts) / n, 1e-9, 1 - 1e-9)
    both = counts / n
    agree1 = p**2 + (1 - p) ** 2
    one = p[:, None] - both
    agree2 = both**2 + one**2 + one.T**2 + (1 - p[:, None] - p[None, :] + both) ** 2
    related = np.abs(both - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    np.fill_diagonal(related, 0)

    def groups(m: int) -> list[list[int]]:
        free, out = set(range(BITS)), []
        for i in range(m):
            size = BITS * (i + 1) // m - BITS * i // m
            group = [max(sorted(free), key=lambda b: related[b, sorted(free)].sum())]
            free.discard(group[0])
            while len(group) < size:
                group.append(max(sorted(free), key=lambda b: related[b, group].sum()))
                free.discard(group[-1])
            out.append(group)
        return out

    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        probes, rest = 1, len(group)
        for i in range(t):
            probes = probes * (rest - i) // (i + 1)
        all_agree = agree1[group[0]]
        for i in range(1, len(group)):
            nearest = group[int(np.argmax(related[group[i], group[:i]]))]
            all_agree *= min(1.0, agree2[group[i], nearest] / agree1[nearest])
        odds = np.ones(1)
        for b in group:
            odds = np.convolve(odds, [agree1[b], 1 - agree1[b]])
        pairs = sum(odds[d] / odds[0] * all_agree * _choose(len(group) - d, t - d) for d in range(t + 1))
        return n * probes * PROBE + n * n / 2 * pairs * PAIR

    best, least = [], float("inf")
    for m in range(2, distance + 2):
        some = groups(m)
        # states: the sum of (threshold + 1) so far, which has to end at distance + 1
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in some:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (so_far, chosen) in states.items():
                for t in range(-1, min(2, distance - used) + 1):
                    total = so_far + cost(group, t)
                    if used + t + 1 <= distance + 1 and total < after.get(used + t + 1, (float("inf"),))[0]:
                        after[used + t + 1] = (total, [*chosen, t])
            states = after
        if distance + 1 in states and states[distance + 1][0] < least:
            least, thresholds = states[distance + 1]
            best = [(g, t) for g, t in zip(some, thresholds, strict=True) if t >= 0]
    return best


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def masks(partitions: list[tuple[list[int], int]]) -> list[int]:
    """Signed 64-bit masks: fingerprints within a partition's threshold agree under one of its masks."""
    out = []
    for bits, t in partitions:
        for without in combinations(bits, t):
            mask = sum(1 << b for b in bits if b not in without)
            out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def allowed(n: np.ndarray, sketch: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets ``others`` may be similar to set i by their sizes and sketches; one that is similar always may."""
    differ = np.maximum(np.bitwise_count((sketch[others] ^ sketch[i]).view(np.uint64)).sum(1, dtype=np.int64), np.abs(n[others] - n[i]))
    return differ <= (1 - similarity) / (1 + similarity) * (n[others] + n[i]) + 1e-6


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what all links within the distance connect: at most one less than fps."""
    rest, links = np.unique(fps).view(np.uint64), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                found = rest[near]
                links += [(int(here.astype(np.int64)), x) for x in found.view(np.int64).tolist()]
                todo.extend(found)
                rest = rest[~near]
    return links


def set_forest(fps: np.ndarray, n: np.ndarray, sketch: np.ndarray, distance: int, similarity: float) -> list[tuple[int, int]]:
    """Like forest(), of places, for sets: a link also needs sizes and sketches that allow the similarity."""
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            near = np.bitwise_count((fps[rest] ^ fps[here]).view(np.uint64)) <= distance
            near[near] = allowed(n, sketch, here, rest[near], similarity)
            if near.any():
                links += [(here, x) for x in rest[near]]
                todo.extend(rest[near])
                rest = rest[~near]
    return links


def dealt(nodes: DataFrame, distance: int, block: int) -> DataFrame:
    """(slot, v, i, j) and the columns of nodes, in that order: rows of a group lie together, and fps within the distance share one.

    The first column of nodes tells them apart; by it the nodes of a crowded probe are dealt to blocks.
    """
    n = nodes.count()
    partitions = plan(bit_counts(nodes), n, distance)
    probe = F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks(partitions)))).alias("slot", "mask")
    probes = nodes.select("*", probe).select(*nodes.columns, "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("v"))
    crowded = probes.groupBy("slot", "v").count().filter(F.col("count") > block).select("slot", "v", F.ceil(F.col("count") / block).cast("int").alias("m"))
    groups = (
        probes.join(crowded, ["slot", "v"], "left")
        .withColumn("own", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64(nodes.columns[0]), F.col("m"))).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("m") - 1))))
        .select("slot", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *nodes.columns)
    )
    return groups.repartition("slot", "v", "i", "j").sortWithinPartitions("slot", "v", "i", "j")


def links(nodes: DataFrame, distance: int = 4, *, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that join what all links within the distance join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made() -> pa.RecordBatch | None:
            if len(held) > 1 and (found := forest(np.array(held, np.int64), distance)):
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
            return None

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *k, fp in zip(*columns, strict=True):
                if k != key:
                    if out := made():
                        yield out
                    key, held = k, []
                held.append(fp)
        if out := made():
            yield out

    return dealt(nodes.select("fp"), distance, block).mapInArrow(tidy(run), "a long, b long").distinct()


def set_links(nodes: DataFrame, similarity: float, distance: int = DISTANCE, *, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes (node, fp, n, sketch) that join what all fingerprints within the distance join, if the sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(node: np.ndarray, *of: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(node) > 1 and (found := set_forest(*of, distance, similarity)):
                a, b = (node[list(c)] for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [_table(batch.columns[-1])]
            held = [np.concatenate(c) for c in zip(held, rows, strict=True)] if held else rows
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            for x, y in zip([0, *starts.tolist()], starts.tolist(), strict=False):
                yield from made(*(c[x:y] for c in held[4:]))
            held = [c[starts[-1] if len(starts) else 0 :] for c in held]
        if held:
            yield from made(*held[4:])

    blocks = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("i", "j")]  # nodes of an uncrowded probe have none
    grouped = dealt(nodes.select("node", "fp", "n", "sketch"), distance, block)
    return grouped.select(F.col("slot").cast("long"), "v", *blocks, "node", "fp", "n", "sketch").mapInArrow(tidy(run), "a long, b long").distinct()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b) that are no roots, and their roots: each component's root is its least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    above = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        above[max(x, y)] = min(x, y)
    for i, x in enumerate(above):  # what is above a node is before it
        above[i] = above[x]
    root = np.array(above, np.int64)
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def connected(edges: DataFrame, *, most: int = 60, like: DataFrame | None = None, few: int = 0) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): each component's root is its least node.

    Alternates large-star and small-star; each round is written to the shared folder. Its number grows with
    the logarithm of the longest path. RuntimeError beyond ``most`` rounds.

    With ``few`` links at most they are gathered in one task instead, which gives the same rows. A round is half a
    dozen jobs whatever its size, and each leaves threads, plans and statistics in the driver for a while.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = zip(*([np.zeros(0, np.int64)] * 2, *([c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in roots_of(np.concatenate(a), np.concatenate(b))], ["node", "root"])

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links", like=like)

    if few and now.count() <= few:
        return stored(now.repartition(1).mapInArrow(tidy(run), "node long, root long"), "roots")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most):
        ways = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined(ways, least, "a", 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct().persist()  # for this round; lost parts come from the last one's table
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, least, "a", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a != b").distinct(), "stars", like=now)
        large.unpersist()
        after = mark(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"no end after {most} rounds")


def near_duplicates(docs: DataFrame, distance: int = 4, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the least id of the row's component.

    Null and empty texts have the fingerprint zero and link like any other; repeated rows stay, in one
    component; a null id stays null and never names a component with other ids; an empty table gives no
    rows; further columns are ignored.
    """
    docs = stored(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle), "fingerprints", like=docs)
    nodes = stored(docs.groupBy("fp").agg(F.min(id_column).alias("first"), F.count("*").alias("rows")), "nodes", like=docs)
    roots = connected(links(nodes, distance, block=block), like=docs)
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.col("rows").alias("n"), F.coalesce("root", "fp").alias("root")), "rooted", like=docs)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    component = joined(rooted.withColumnRenamed("n", "rows"), named, "root", nodes.count()).select("fp", "component_id", F.col("rows").alias("n"))
    return joined(docs, component, "fp", docs.count()).select(id_column, "fp", "component_id")


def _table(lists: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a table."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // max(1, len(lists)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *arrays]))


def common_shingles(docs: DataFrame, text_column: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several of a sixteenth of the texts hold, COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in pieces([t or "" for t in texts], 1_000_000):
                found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts[part]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["s"])

    some = docs.filter(F.pmod(F.xxhash64(text_column), F.lit(16)) == 0).select(text_column).mapInArrow(tidy(run), "s long")
    rows = some.groupBy("s").agg(F.count("*").alias("n")).filter("n > 3").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, n = rows.column("s").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefixes(docs: DataFrame, similarity: float, *, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, h, node, fp, n, sketch, prefix) for each row: its words' hash, and of its shingles the fingerprint, how many, a sketch and the first.

    A bit of the sketch is the parity of how many shingles fall on it, so two sets differ in as many shingles
    at least as their sketches do in bits.

    Shingles are ordered by how common they are, then by hash. Two sets of a Jaccard similarity have one of
    the first n - ceil(similarity n) + 1 in common, whatever the order is, so no pair is lost.
    """
    import xxhash

    common, count = common_shingles(docs, text_column, shingle)
    of = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            at = 0
            for part in pieces(texts, 1_000_000):
                node, fp, size, sketch, first = [], [], [], [], []
                for t in texts[part]:
                    hashes = shingle_hashes(t, shingle)
                    fp.append(fingerprint_of(hashes))
                    found = np.unique(hashes).view(np.int64)
                    n = len(found)
                    sketch.append(np.packbits(np.bincount(found & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64))
                    if len(common) and n:
                        near = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        found = found[np.lexsort((found, np.where(common[near] == found, count[near], 0)))]
                    node.append(of(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), 42))
                    size.append(n)
                    first.append(found[: n - math.ceil(similarity * n - 1e-9) + 1])
                many = len(node)
                columns = [batch.column(0).slice(at, many), batch.column(1).slice(at, many), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, fp)), pa.array(size, pa.int64()), _lists(sketch), _lists(first)]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "h", "node", "fp", "n", "sketch", "prefix"])
                at += many

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.xxhash64(text_column).alias("h"), text_column).mapInArrow(tidy(run), f"`{id_column}` {kind}, h long, node long, fp long, n long, sketch array<long>, prefix array<long>")


def shared(postings: DataFrame) -> DataFrame:
    """The postings (s, node, n, pos), once each, whose shingle s another node's prefix holds too."""
    names = ["s", "node", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = [np.zeros(0, np.int64)] * 4, False
        for batch in batches:
            rows = [np.concatenate((k, c.to_numpy(zero_copy_only=False))) for k, c in zip(last, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
            rows = [c[new] for c in rows]
            same = rows[0][1:] == rows[0][:-1]
            keep = np.append(known, same) | np.append(same, False)
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in rows], names)
            last, known = [c[-1:] for c in rows], bool(keep[-1])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names)

    return postings.select(*names).repartition("s").sortWithinPartitions("s", "node").mapInArrow(tidy(run), "s long, node long, n long, pos long")


def spread(postings: DataFrame, most: int = SPREAD) -> DataFrame:
    """The postings of ``most`` shingles of each node at even steps from the rarest to the most common one; all if there are fewer."""
    own = Window.partitionBy("node")  # one text's prefix
    ranked = postings.withColumn("rank", F.row_number().over(own.orderBy("pos"))).withColumn("of", F.count("*").over(own))
    return ranked.filter(F.expr(f"of <= {most} OR rank * {most} div of > (rank - 1) * {most} div of")).drop("rank", "of")


def neighbours(postings: DataFrame, similarity: float, *, mixed: bool = False) -> DataFrame:
    """(a, b): nodes that follow each other among those with a shingle s in common and whose sizes allow the similarity.

    They are in order of size, or, if ``mixed``, in another order for each shingle, so shingles that a whole group
    holds give different pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            s, n, node = last = [np.concatenate((k, c.to_numpy(zero_copy_only=False))) for k, c in zip(last, batch.columns, strict=True)]
            met = (s[1:] == s[:-1]) & (np.minimum(n[:-1], n[1:]) >= similarity * np.maximum(n[:-1], n[1:]) - 1e-9)
            a, b = node[:-1][met], node[1:][met]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            last = [c[-1:] for c in last]

    order = [F.xxhash64("s", "node")] if mixed else ["n", "node"]
    return postings.repartition("s").sortWithinPartitions("s", *order).select("s", "n", "node").mapInArrow(tidy(run), "a long, b long").distinct()


def candidates(postings: DataFrame, similarity: float, *, block: int = BLOCK, sketches: DataFrame | None = None) -> DataFrame:
    """(a, b): all pairs of nodes with a shingle s in common that may be similar and whose roots differ.

    A pair passes if its sizes allow the similarity and if, were s their first common shingle, the rest of
    both sets would be long enough; at the first common one it is. With ``sketches`` (node, sketch) these have to
    allow it too, and the many pairs that they rule out never leave the task that compares them.
    """
    sketch = "sketch" if sketches is not None else F.array().cast("array<long>").alias("sketch")
    crowded = postings.groupBy("s").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("s", F.ceil(F.col("m") / block).cast("int").alias("m"))
    met = postings.join(crowded, "s")
    met = met.join(sketches.select("node", "sketch"), "node") if sketches is not None else met
    groups = (
        met
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "pos", "root", sketch)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(a: list, b: list) -> pa.RecordBatch:
            a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def made(node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b, held = [], [], 0
            for i in range(len(node) - 1):
                least = similarity / (1 + similarity) * (n[i] + n[i + 1 :]) - 1e-6
                ok = (root[i + 1 :] != root[i]) & (np.minimum(n[i], n[i + 1 :]) >= least) & (np.minimum(n[i] - pos[i], n[i + 1 :] - pos[i + 1 :]) >= least)
                others = i + 1 + np.flatnonzero(ok)
                b.append(node[others[allowed(n, sketch, i, others, similarity)]])
                a.append(np.full(len(b[-1]), node[i]))
                held += len(b[-1])
                if held > 200_000:
                    yield batch_of(a, b)
                    a, b, held = [], [], 0
            if held:
                yield batch_of(a, b)

        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [_table(batch.columns[-1])]
            held = [np.concatenate(c) for c in zip(held, rows, strict=True)] if held else rows
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0)) + 1
            for x, y in zip([0, *starts.tolist()], starts.tolist(), strict=False):
                yield from made(*(c[x:y] for c in held[3:]))
            held = [c[starts[-1] if len(starts) else 0 :] for c in held]
        if held:
            yield from made(*held[3:])

    grouped = groups.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    return grouped.select("s", F.col("i").cast("long"), F.col("j").cast("long"), "node", "n", F.col("pos").cast("long"), "root", "sketch").mapInArrow(tidy(run), "a long, b long").distinct()


def similar(docs: DataFrame, pairs: DataFrame, keys: DataFrame, similarity: float, *, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity; keys: (node, id, h, n, sketch), a row of docs for each node.

    Whole sets are made of pairs that their sizes and sketches allow; none that is similar is dropped by these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            for part in pieces(texts, 1_000_000):
                found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts[part]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), _lists(found)], ["node", "set"])
                at += len(found)

    of = lambda c: keys.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    differ = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    most = (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6
    pairs = stored(pairs.join(of("a"), "a").join(of("b"), "b").filter(F.greatest(differ, F.abs(F.col("na") - F.col("nb"))) <= most).select("a", "b"), "candidates", like=docs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(keys, "node").select("node", F.col(id_column).alias("_id"), F.col("h").alias("_h"))
    wanted = stored(wanted, "wanted", like=docs)
    docs = docs.select(id_column, text_column)
    texts = docs.join(wanted, docs[id_column].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_column]) == F.col("_h"))).select("node", docs[text_column])
    sets = stored(texts.mapInArrow(tidy(run), "node long, set array<long>"), "shingles", like=docs).dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("q")), "b")
    met = F.size(F.array_intersect("p", "q"))
    return both.filter(met >= similarity * (F.size("p") + F.size("q") - met) - 1e-9).select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = 0.8, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(id, h, root) for each row of docs, h its text's hash: texts of one root are linked by pairs of the similarity.

    The first pass links fingerprints within DISTANCE bits, and neighbours by SPREAD shingles a node, so a large group
    is mostly joined by a few pairs a node; the second takes all pairs left between groups, by prefix filtering. Both
    are verified on whole shingle sets; no pair is lost. Null and empty texts have no shingles and are one group; repeated rows stay, in one group.
    """
    importable(docs.sparkSession)
    give_back_driver(docs.sparkSession)
    columns = {"id_column": id_column, "text_column": text_column, "shingle": shingle}
    rows = stored(prefixes(docs, similarity, **columns), "prefixes", like=docs)
    one = rows.groupBy("node").agg(F.min(F.struct(F.col(id_column).isNull().alias("z"), id_column, "h", "fp", "n", "sketch")).alias("r"))
    keys = stored(one.select("node", f"r.{id_column}", "r.h", "r.fp", "r.n", "r.sketch"), "nodes", like=docs)
    postings = stored(shared(rows.select("node", "n", F.posexplode("prefix").alias("pos", "s")).withColumn("pos", F.col("pos").cast("long"))), "postings", like=docs)
    give_back_driver(docs.sparkSession)
    first = set_links(keys, similarity, block=block).union(neighbours(spread(postings), similarity, mixed=True)).distinct()
    near = connected(similar(docs, first, keys, similarity, **columns), like=docs, few=few)
    give_back_driver(docs.sparkSession)
    marked = postings.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = similar(docs, candidates(marked, similarity, block=block, sketches=keys), keys, similarity, **columns)
    rooted = near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)
    final = connected(rooted, like=docs, few=few)
    give_back_driver(docs.sparkSession)
    return rows.select(id_column, "h", "node").join(final, "node", "left").select(id_column, "h", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = 0.8, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs without near-duplicates: of each group of similar_groups one row stays, whole.

    It is the one with the least id, null ids last, then the least hash of its text. Of rows that share both
    any one stays. Rows are told apart by id and text, so an id that repeats with other texts takes none along.
    """
    found = stored(similar_groups(docs, similarity, id_column=id_column, text_column=text_column, **options), "groups", like=docs)
    best = found.groupBy("root").agg(F.min(F.struct(F.col(id_column).isNull().alias("z"), id_column, "h")).alias("r"))
    best = best.select(F.col(f"r.{id_column}").alias("_id"), F.col("r.h").alias("_h"))
    times = found.groupBy(F.col(id_column).alias("_k"), "h").count()
    kept = stored(best.join(times, F.expr("_id <=> _k AND _h = h")).select("_id", "_h", "count"), "kept", like=docs)
    again = kept.filter("count > 1").select("_id", "_h")

    def those(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs[id_column].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_column]) == F.col("_h")))

    once = those(kept.filter("count = 1")).select(*(docs[c] for c in docs.columns))
    return once.unionAll(those(again).dropDuplicates(["_id", "_h"]).select(*(docs[c] for c in docs.columns)))
