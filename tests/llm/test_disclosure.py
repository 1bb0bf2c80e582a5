"""Disclosing terms against counts and the formula made by hand."""

import math
import random
import re

from pyspark.sql import functions as F

from arborlake.llm import pii


def brute(rows, threshold=0.8, prior=1.0):
    """{(entity, term): disclosure} of all entities and terms, from sets of documents."""
    n, holds, has = len(rows), {}, {}
    for d, (_, text) in enumerate(rows):
        for e in set(re.findall(r"[a-z]+@[a-z]+\.org", text or "")):
            holds.setdefault("email:" + e, set()).add(d)
        for t in set(re.findall(r"[^\W_]+", (text or "").lower())):
            has.setdefault(t, set()).add(d)
    out = {}
    for c, docs in holds.items():
        for t, of in has.items():
            if docs & of and len(docs) < n:
                given = (len(docs & of) + prior * len(docs) / n) / (len(of) + prior)
                d = math.log(given * n / len(docs)) / math.log(n / len(docs))
                if d >= threshold:
                    out[c, t] = d
    return out, holds


def corpus(rng):
    common = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(400):
        words = rng.choices(common, k=rng.randint(0, 25)) + [f"Rare{rng.randrange(150)}" for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.15:
            words += [f"p{rng.choice('abcdef') * rng.randint(1, 3)}@mail.org", "Zoë"]
        if i in (7, 8, 9):
            words += ["Zorblax", "zq@example.org", "other@example.org"]
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", "]).join(words)))
    return [*rows, rows[7], (None, rows[8][1]), (None, None), (500, ""), (501, "Zorblax only")]


def test_disclosures_are_those_of_the_formula(spark):
    rows = corpus(random.Random(21))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, entity int").repartition(4)
    for threshold, prior in ((0.8, 1.0), (0.5, 3.0)):
        want, holds = brute(rows, threshold, prior)
        first = {}
        for c, docs in sorted(holds.items()):
            first.setdefault(frozenset(docs), c)
        found = pii.scanned(df)
        scored, places = pii.disclosing(df, found, threshold=threshold, prior=prior)
        got = {(r.entity, r.term): r.disclosure for r in scored.collect()}
        assert set(got) == {(c, t) for c, t in want if first[frozenset(holds[c])] == c} and all(abs(d - want[key]) < 1e-9 for key, d in got.items())
        spots = {(r.k, r.s, r.e, round(r.disclosure, 9)) for r in places.collect()}
        truth = set()
        for d, (k, text) in enumerate(rows):
            for m in re.finditer(r"[^\W_]+", text or ""):
                worst = max((x for (c, t), x in want.items() if t == m[0].lower() and d in holds[c]), default=None)
                if worst is not None:
                    truth.add((k, m.start(), m.end(), round(worst, 9)))
        assert spots == truth and truth


def test_disclosing_terms_are_spans_and_go(spark):
    rows = corpus(random.Random(22))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, holds = brute(rows)
    found = {(r.doc_id, r.spans, r.n_term) for r in pii.find_personal_data(df).collect()}
    for d, (k, text) in enumerate(rows):
        terms = {t for (c, t) in want if d in holds[c]}
        mails = [(m.start(), m.end()) for m in re.finditer(r"[a-z]+@[a-z]+\.org", text or "")]
        spans = [(m.start(), 4, m.end(), "term") for m in re.finditer(r"[^\W_]+", text or "") if m[0].lower() in terms and not any(m.start() < b and a < m.end() for a, b in mails)]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans + [(a, 0, b, "email") for a, b in mails]))
        assert (k, listed, len(spans)) in found
    clean = {(r.doc_id, r.text) for r in pii.sanitise(df).collect()}
    gone = [t for k, t in clean if k in (7, 8, 9)]
    assert all("orblax" not in t and "@" not in t and "[EMAIL]" in t for t in gone) and (501, "Zorblax only") in clean and (None, None) in clean
    assert pii.sanitise(df).count() == len(rows) and pii.sanitise(df.limit(0)).count() == 0


def test_a_list_of_entities_meets_its_terms_once(spark):
    mails = " ".join(f"m{i}@mail.org" for i in range(300))
    df = spark.createDataFrame([(0, "Ann " + mails), (1, "Ann " + mails), *((i, "plain words") for i in range(2, 60))], "doc_id long, text string")
    found = pii.scanned(df)
    assert pii.representatives(found.filter(F.size("base") > 0).withColumn("m", F.lit(1))).select("entity").distinct().count() == 1
    scored, _ = pii.disclosing(df, found)
    assert scored.filter("term = 'ann'").select("n_c", "n_t", "n_ct").collect() == [(2, 2, 2)]
