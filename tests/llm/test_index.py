"""The positional index: phrases and proximity against brute force, stored segments, lengths."""

import random
import re

from pyspark.sql import functions as F

from arborlake.llm import decontaminate

LOWER = {i: i + 32 for i in range(65, 91)}


def doc_words(text):
    """Words with their positions, the empty one before a leading separator included."""
    return re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def tables(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(8)] + [(50, None), (51, "--"), (None, "w1 w2 w3 w4"), (3, "w5 w5 w5 w5"), (4, "absent w1 w2 w3")]
    texts = [rng.choice(["", " ", "-- "]) + "  ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + rng.choice(["", "."]) for _ in range(60)]
    texts += ["w1 " * 3000 + (items[0][1] or "") + " w2" * 3000, None, "", "..."]
    docs = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (5, texts[5], "c"), (5, texts[6], "c"), (None, texts[1], "c")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(5), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, pos int")


def brute_phrases(docs, items, window):
    out = set()
    for k, text, _ in docs:
        w = doc_words(text)
        for item, phrase in items:
            t = [x for x in doc_words(phrase) if x]
            least = min(window, len(t))
            for delta in range(-len(t), len(w)):
                run = 0
                for i in range(len(t) + 1):
                    if i < len(t) and 0 <= delta + i < len(w) and w[delta + i] == t[i]:
                        run += 1
                        continue
                    if run and run >= least:
                        out.add((k, item, delta + i - run, run))
                    run = 0
    return out


def test_phrases_are_those_of_brute_force(spark):
    for seed, window in ((1, 3), (2, 2), (3, 5)):
        docs, items, df, bench = tables(spark, seed)
        assert {tuple(r) for r in decontaminate.phrase_matches(df, bench, window).collect()} == brute_phrases(docs, items, window)
    assert decontaminate.phrase_matches(df.limit(0), bench, 3).count() == 0 and decontaminate.phrase_matches(df, bench.limit(0), 3).count() == 0


def test_proximity_is_that_of_brute_force(spark):
    docs, items, df, bench = tables(spark, 4)
    distinct = {(k, t) for k, t, _ in docs}
    counts = {}
    for _, text, _ in docs:
        for w in doc_words(text):
            counts[w] = counts.get(w, 0) + 1
    for span in (3, 6):
        want = []
        for k, text in distinct:
            w = doc_words(text)
            for item, phrase in {(i, t) for i, t in items}:
                terms = {x for x in doc_words(phrase) if x}
                if not terms or any(x not in counts for x in terms):
                    continue
                rarest = min(terms, key=lambda x: (counts[x], x))
                want += [(k, item, at) for at, x in enumerate(w) if x == rarest and terms <= set(w[max(0, at - span) : at + span + 1])]
        got = [tuple(r) for r in decontaminate.proximity_matches(df, bench, span).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.proximity_matches(df.limit(0), bench, 3).count() == 0


def test_stored_segments_hold_postings_and_lengths(spark):
    docs, _, df, _ = tables(spark, 5)
    terms = spark.createDataFrame([("w1",), ("é",), ("É",), ("nowhere",)], "word string")
    index = decontaminate.stored_index(df, terms)
    assert index.inputFiles()
    lists = index.filter(F.col("word").isin("w1", "é", "É")).select("word", "k", "pos").collect()
    assert sorted(map(tuple, lists), key=str) == sorted(((x, k, i) for k, t, _ in docs for i, x in enumerate(doc_words(t)) if x in ("w1", "É")), key=str)
    found = decontaminate.lengths(index).select("k", "n_words").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((k, sum(x != "" for x in doc_words(t))) for k, t, _ in docs), key=str)


def test_item_of_shared_common_words_makes_no_place_where_it_is_not(spark):
    """100 items that share ten common words, and a long document of these words."""
    common = [f"c{i}" for i in range(10)]
    rng = random.Random(6)
    items = [(i, " ".join(rng.sample(common, 10)) + f" own{i}") for i in range(100)]
    docs = [(0, " ".join(rng.choices(common, k=2000)), "c"), (1, f"begin {items[7][1]} end", "c")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, word string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.phrase_matches(df, bench, 10).collect()} == brute_phrases(docs, items, 10)
