"""SimHash, decontamination, personal data, classifiers and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborlake.llm import decontaminate, pii, quality, simhash, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, fp string, k string, h string, hits int, n_chars long"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "x", None, "y", i, None) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None), (901, "", "x", None, None, 0, 0), (902, " \n", "x", None, None, 0, 0), (None, "nobody's text", "x", None, None, 0, 0), (first, texts[0] if texts else "t", "x", None, "y", 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(rng, n):
    return ["".join(rng.choices("abcdeé", k=rng.randint(2, 5))) for _ in range(n)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [2048, 8])
def test_simhash(spark, block):
    rng = random.Random(1)
    base = words_of(rng, 300)
    texts = ["A B c", "one", "É É", "x" * 9000]
    for i in range(120):
        w = list(base)
        w[rng.randrange(300)] = f"new{i}"
        texts.append(" ".join(w))
    texts += [" ".join(words_of(rng, 80)) for _ in range(40)] + texts[4:14]
    df = frame(spark, texts)
    rows = simhash.near_duplicates(df, block=block).collect()
    source = df.collect()
    assert len(rows) == len(source)
    by_text = {}
    for r in source:
        by_text.setdefault(r.doc_id, r.text)
    ids = [r.doc_id for r in rows]
    fps = [brute_fingerprint(by_text[i]) for i in ids]
    assert [r.fp & (2**64 - 1) for r in rows] == fps
    roots = brute_components(fps)
    for r, k in zip(rows, roots, strict=True):
        group = [i for i, q in zip(ids, roots, strict=True) if q == k and i is not None]
        assert r.component_id == (min(group) if group else None)
    kept = simhash.keep_one(df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({r.component_id for r in rows} - {None})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_lose_nothing_at_any_plan(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**64, 25, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        for _ in range(8):
            flips = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    counts = simhash.bit_counts(nodes)
    assert counts[0, 0] == sum(f & 1 for f in fps) and counts[3, 63] == sum((f >> 3 & 1) & (f >> 63) for f in fps)
    for n in (200, 10**6, 10**9, 10**12):
        partitions = simhash.plan(counts * (n / len(fps)), n, 4)
        assert sum(t + 1 for _, t in partitions) == 5 and len({b for g, _ in partitions for b in g}) == sum(len(g) for g, _ in partitions)
        masks = [m & (2**64 - 1) for m in simhash.masks(partitions)]
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if bin(a ^ b).count("1") <= 4:
                    assert any((a ^ b) & m == 0 for m in masks)
    edges = simhash.connected(simhash.links(nodes, 4, block=4)).collect()
    root = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in edges}
    roots = brute_components(fps)
    got = [root.get(f, f) for f in fps]
    assert len(set(zip(got, roots, strict=True))) == len(set(got)) == len(set(roots))


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(-5, -4), (7, 7)]
    found = {r.node: r.root for r in simhash.connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[101 + i] == 100 for i in range(40)) and found[-4] == -5
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(1, " ".join(words_of(rng, 30))), (2, "Short item: only five words"), (3, None), (10, "..."), (11, " ".join(words_of(rng, 12))), (12, "same same same same same same same same same same same same"), (20, "É é 'quoted' word's end")]
    passage = items[0][1].split()
    texts = [
        "before " + " ".join(passage) + " after", " ".join(passage[5:15]).upper().replace("É", "é"), " ".join(passage[5:14]), "x; " + ", ".join(passage[3:14]) + " y " + " ".join(passage[10:25]), "SHORT... item only (five) words short item only five",
        "same " * 25, "É é quoted word s end", "é é quoted word s end", "nothing here", items[4][1] + " " + items[4][1], "--- " + items[1][1],
    ]
    df = frame(spark, texts)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, k string")
    windows = {}
    for key, text in items:
        w = doc_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(key)
    want = []
    for r in df.collect():
        w, hit, names = doc_words(r.text), set(), set()
        for g, keys in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    names |= keys
        want.append((r.doc_id if r.doc_id is not None else -1, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    got = decontaminate.contamination(df, bench).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    places = {(r.k, r.item, r.length) for r in decontaminate.phrase_matches(df, bench).collect()}
    assert (0, 1, 30) in places and (3, 1, 11) in places
    near = decontaminate.proximity_matches(df, spark.createDataFrame([(5, "words five item")], "item_id long, text string"), 4)
    assert {r.k for r in near.collect()} == {4, 10}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2:
                total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@mail-1.example.org", "@", ".", "a@b", "@b.co", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "+4930123456789", "é", "👍", " ", "  ", "-", "word", "_", "%", "79927398713", "0" * 16, "\n", "+", "99999999999999999999.1.1.1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(300)] + ["9" * 5000, "a" * 20_000 + "@", "a." * 3000 + "@b.c", "+1" + " 2" * 4000, "@" * 3000, "1 " * 6000]
    texts += [f"{filler} contact Zorblax Quimby at zq@example.org today {filler}" for filler in ("one two", "three four", "five six", "seven eight")] + [f"unrelated {i} today at contact" for i in range(40)]
    df = frame(spark, texts)
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r.doc_id, r.text)
    got = pii.find_personal_data(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = brute_spans(by_id[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), by_id[r.doc_id][:80]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("term")] == (want.split(",") if want else [])
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    named = [r for r in got if "zq@example.org" in (by_id[r.doc_id] or "")]
    terms = {by_id[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for r in named for s in r.spans.split(",") if s.startswith("term")}
    assert {"Zorblax", "Quimby"} <= terms and not terms & {"at", "today", "contact"}
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert clean[900].text is None and clean[901].text == "" and pii.sanitise(df).columns == df.columns
    for r in named:
        assert "Zorblax" not in clean[r.doc_id].text and "[EMAIL]" in clean[r.doc_id].text and "today" in clean[r.doc_id].text
    assert all(clean[i].text == t for i, t in by_id.items() if t is not None and not brute_spans(t) and i in clean)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.BoostedTrees().fit(x[:1000], y[:1000])
    assert ((model.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    slow = np.full(20, model.base)
    for row in range(20):
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            slow[row] += leaf[node - len(feature)]
    assert np.allclose(model.predict(x[:20]), 1 / (1 + np.exp(-slow)))
    assert quality.BoostedTrees().fit(np.zeros((0, 4)), np.zeros(0)).predict(x[:3]).shape == (3,)
    assert quality.BoostedTrees(trees=3).fit(x[:9], np.ones(9)).predict(x[:2]).min() > 0.9


def labelled(spark, marks, n=400):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        words = words_of(rng, 40)
        bad = i % 3 == 0
        texts.append(marks(words, bad, rng))
        labels.append((i, int(not bad), int(bad), None))
    return frame(spark, texts), spark.createDataFrame([*labels, (5000, 1, 1, 1), (None, 1, 1, 1), (3, None, 7, 1)], "doc_id long, quality int, toxic int, text int")


@pytest.mark.parametrize("operator", ["quality", "toxic"])
def test_classifiers_on_held_out_documents(spark, operator):
    if operator == "quality":
        df, labels = labelled(spark, lambda w, bad, rng: " ".join(x + "###" for x in w) if bad else " ".join(w) + ".")
        found = quality.score_quality(df, labels).collect()
    else:
        df, labels = labelled(spark, lambda w, bad, rng: " ".join([*w, f"awful{rng.choice('xyz')}{rng.choice('qr')}"] if bad else w))
        found = toxicity.score_toxicity(df, labels).collect()
    import zlib

    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    folds, out = (4, 2) if operator == "quality" else (3, 1)
    truth = {r.doc_id: r[operator] for r in labels.collect() if r[operator] in (0, 1)}
    test = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in found if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    empty = (quality.score_quality if operator == "quality" else toxicity.score_toxicity)(df, labels.limit(0))
    assert empty.count() == df.count()
    assert (quality.score_quality if operator == "quality" else toxicity.score_toxicity)(df.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    item = " ".join(words_of(rng, 20))
    df, labels = labelled(spark, lambda w, bad, r: " ".join([*w, "awfulness"] if bad else w), 300)
    extra = [(600, f"start {item} end", 0), (601, "mail me at a.b@example.org " + " ".join(words_of(rng, 50)), 0), (602, None, 0)]
    docs = df.filter("doc_id < 300").dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in extra], docs.schema)).unionByName(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(700).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, now = {r.doc_id for r in now.select("doc_id").collect()}, spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "toxicity":
            assert {i for i in before - after} and all(i % 3 == 0 for i in before - after) and len(before - after) > 90
        if name == "near_duplicates":
            assert before - after == {700}
        if name == "decontamination":
            assert before - after == {600}
        if name == "personal_data":
            assert before == after and "[EMAIL]" in now.filter("doc_id = 601").first().text
    assert now.agg(F.sum("length")).first()[0] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length").collect()))[:3] is not None
