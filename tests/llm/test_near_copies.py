"""The pipeline's near-duplicate and decontamination stages: near copies against brute force, null and repeated ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import decontaminate, shared, simhash


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(n)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def copies(rng):
    """Texts with copies of similarities from about 0.7 to 0.97, copies of copies, a shared passage, short ones."""
    passage, out = " ".join(words_of(rng, 60)), []
    for changes in [1, 2, 3, 4, 5, 6, 7, 8] * 4:
        base = words_of(rng, 220)
        copy = list(base)
        for at in rng.sample(range(5, 215), changes):
            copy[at] = "new" + words_of(rng, 1)[0]
        out += [" ".join(base), " ".join(copy).upper()]
    base = words_of(rng, 150)
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(150), 2):
            copy[at] = "other" + words_of(rng, 1)[0]
        out.append(" ".join(copy))
    out += [" ".join(words_of(rng, 50)) + " " + passage for _ in range(30)]
    return [*out, "one two three", "ONE  two\nthree", "one two", "", " \n", "one two three four five six"]


def test_stage_finds_copies_of_similarity_080_to_095(spark):
    import corpus_pipeline

    texts = copies(random.Random(11))
    sets = [shingles(t) for t in texts]
    near = [s for i in range(0, 64, 2) if 0.8 <= (s := jaccard(sets[i], sets[i + 1])) <= 0.95]
    assert len(near) > 12 and min(near) < 0.85 and max(near) > 0.9
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(7)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts)))
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_groups_lose_no_pair(spark, block):
    texts = copies(random.Random(12))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.similar_groups(docs, block=block).collect()}
    want = brute_groups(texts)
    assert len(set(zip([root[i] for i in range(len(texts))], want, strict=True))) == len(set(want)) == len(set(root.values()))


def test_candidates_are_all_pairs_between_groups(spark):
    rows = [(s, node, 10, 0, node % 3) for s in range(3) for node in range(12)]
    found = simhash.candidates(spark.createDataFrame(rows, "s long, node long, n long, pos int, root long"), 0.8, block=3).collect()
    assert {tuple(r) for r in found} == {(a, b) for a in range(12) for b in range(a + 1, 12) if a % 3 != b % 3}
    assert {tuple(r) for r in simhash.neighbours(spark.createDataFrame(rows, "s long, node long, n long, pos int, root long"), 0.8).collect()} == {(a, a + 1) for a in range(11)}


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e = (words_of(rng, 120) for _ in range(5))
    like = lambda w, i: " ".join([*w[:60], f"new{i}", *w[61:]])
    a, near_b, c, d, e, f = " ".join(a), like(b, 1), " ".join(c), " ".join(d), " ".join(e), like(e, 2)
    rows = [(5, a), (5, " ".join(b)), (1, near_b), (7, a), (None, c), (None, c), (3, c), (None, d), (None, d), (None, d), (None, e), (None, f), (8, "x y"), (8, "x y"), (9, "X  y"), (None, None), (None, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, h string").repartition(5)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    last = [r for r in got if r in ((None, e), (None, f))]
    assert len(last) == 1 and sorted(got, key=str) == sorted([(5, a), (1, near_b), (3, c), (None, d), (8, "x y"), (5, None), *last], key=str)


def test_decontamination_takes_only_rows_that_hold_a_window(spark):
    passage = " ".join(words_of(random.Random(14), 20))
    rows = [(None, f"bad {passage}"), (None, "a clean row without an id"), (None, None), (1, passage), (1, "a clean row that shares its id"), (1, passage), (2, f"{passage} bad"), (3, "clean")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, h string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[7]], key=str)


def test_stage_links_fingerprints_by_the_pigeonhole_principle(spark, monkeypatch):
    rng = random.Random(15)
    texts = []
    for _ in range(6):
        base = words_of(rng, 200)
        texts += [" ".join(base), " ".join([*base[:199], "other"]), " ".join([*base[:198], "new", "end"])]
    sets = [np.unique(simhash.shingle_hashes(t, 5)).view(np.int64) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    assert all((fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE for i in range(18) for j in range(i) if i // 3 == j // 3)
    sketches = [np.packbits(np.bincount(s & (simhash.SKETCH - 1), minlength=simhash.SKETCH) & 1).view(np.int64).tolist() for s in sets]
    rows = [(i, int(np.uint64(fp).view(np.int64)), len(s), k) for i, (fp, s, k) in enumerate(zip(fps, sets, sketches, strict=True))]
    for block in (2048, 2):
        links = simhash.set_links(spark.createDataFrame(rows, "node long, fp long, n long, sketch array<long>"), 0.8, block=block)
        assert {(r.node, r.root) for r in simhash.connected(links).collect()} == {(i, i // 3 * 3) for i in range(18) if i % 3}

    def none(postings, *of, **options):
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(simhash, "neighbours", none)
    monkeypatch.setattr(simhash, "candidates", none)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9, 12, 15]


def test_pairs_that_only_share_a_passage_do_not_leave_the_second_pass(spark):
    rng = random.Random(16)
    passage = words_of(rng, 100)
    texts = [" ".join([*passage, *words_of(rng, 40)]) for _ in range(60)]
    texts += [" ".join([*t.split()[:139], "other"]) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.prefixes(docs, 0.8, id_column="doc_id", text_column="text", shingle=5).persist()
    postings = rows.select("node", "n", F.posexplode("prefix").alias("pos", "s"), F.col("node").alias("root"))
    node = {r.doc_id: r.node for r in rows.collect()}
    similar = {tuple(sorted((node[i], node[60 + i]))) for i in range(5)}
    for block in (2048, 8):
        found = {tuple(r) for r in simhash.candidates(postings, 0.8, block=block, sketches=rows).collect()}
        assert similar <= found and len(found) < 50
        assert len(set(simhash.candidates(postings, 0.8, block=block).collect())) > 1000


def test_sketches_allow_every_similar_pair():
    rng = np.random.default_rng(17)
    sets = []
    for _ in range(40):
        base = rng.integers(-(2**63), 2**63 - 1, 200)
        sets += [base, np.append(base[22:], rng.integers(-(2**63), 2**63 - 1, 22))]
    sketch = np.array([np.packbits(np.bincount(s & (simhash.SKETCH - 1), minlength=simhash.SKETCH) & 1).view(np.int64) for s in sets])
    n = np.array([len(s) for s in sets])
    for i in range(0, 80, 2):
        assert len(np.intersect1d(sets[i], sets[i + 1])) / len(np.union1d(sets[i], sets[i + 1])) > 0.8
        assert simhash.allowed(n, sketch, i, np.array([i + 1]), 0.8).all()
        assert not simhash.allowed(n, sketch, i, np.array([(i + 2) % 80]), 0.8).any()


def test_few_links_take_no_rounds_and_give_the_same_roots(spark, monkeypatch):
    rng = random.Random(18)
    path = [(i, i + 1) for i in range(-40, 40)] + [(1000, i) for i in range(1001, 1040)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    rng.shuffle(path)
    edges = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in [*path, *path[:20], (5, 5)]], "a long, b long").repartition(5)
    by_rounds = sorted(tuple(r) for r in simhash.connected(edges).collect())
    assert simhash.connected(edges.limit(0), few=10).count() == 0
    assert sorted(tuple(r) for r in simhash.connected(edges, few=10).collect()) == by_rounds  # too many for one task

    def none(*of, **options):
        raise AssertionError("a round")

    given = []
    texts = copies(random.Random(19))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared.give_back_driver(spark)
    monkeypatch.setattr(simhash, "give_back_driver", given.append)
    monkeypatch.setattr(simhash, "joined", none)  # each round joins
    assert sorted(tuple(r) for r in simhash.connected(edges, few=1000).collect()) == by_rounds
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(brute_groups(texts)))
    assert len(given) > 3 and set(map(id, given)) == {id(spark)}
