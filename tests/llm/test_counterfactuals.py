"""Counterfactuals of the toxicity classifier, its sparse fit, and neutral mentions in real documents."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.llm import labelled, quality, toxicity

REAL = "/root/testdata/sf0.01"


def test_counterfactuals_swap_or_insert_in_order():
    assert toxicity.counterfactual("The Women sang, and a man.") == ("The Men sang, and a woman.", True)
    text, swap = toxicity.counterfactual("Plain words, nothing else.")
    assert not swap and text != "Plain words, nothing else."
    terms = {w for g in toxicity.IDENTITY for w in g}
    put = [w for w in text.split() if w.strip(",.") in terms]
    assert len(put) == 1 and text.replace(f" {put[0].strip(',.')}", "", 1) == "Plain words, nothing else."
    assert toxicity.counterfactual("")[0].strip() in terms and toxicity.counterfactual("x", ()) == ("x", False)
    assert toxicity.counterfactual("a red one", (("red", "blue"),)) == ("a blue one", True)
    found, added, lacked, swaps = toxicity._examples(["The women sang", "plain", ""], toxicity.IDENTITY)
    for i, text in enumerate(["The women sang", "plain", ""]):
        before, after = set(toxicity.features(text)), set(toxicity.features(toxicity.counterfactual(text)[0]))
        assert set(found[i].as_py()) == before and set(added[i].as_py()) == after - before and set(lacked[i].as_py()) == before - after
    assert swaps.to_pylist() == [True, False, False]


def examples(texts, groups=toxicity.IDENTITY):
    return toxicity._examples(texts, groups)


def test_fit_reaches_the_optimum_over_all_features():
    """No weight, in the model or not, can move and lower the loss (subgradient conditions)."""
    rng = random.Random(31)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=12) + (["vile"] if i % 5 == 0 and rng.random() < 0.8 else [])) for i in range(300)]
    y = np.array([float(i % 5 == 0) for i in range(300)], np.float32)
    found, added, lacked, _ = examples(texts)
    model = toxicity.Model(penalty=5.0, steps=5000, most=7)
    model.fit(found, added, lacked, y)
    assert model.pairs == 300 and model.weight[toxicity.features("vile")].sum() > 1
    x = np.zeros((300, toxicity.SPACE), np.float32)
    change = np.zeros((300, toxicity.SPACE), np.float32)
    for i in range(300):
        x[i, found[i].as_py()] = 1
        change[i, added[i].as_py()] = 1
        change[i, lacked[i].as_py()] -= 1
    share = np.where(y > 0, 4.0, 1.0)
    share /= share.sum()
    slope = x.T @ (share * (1 / (1 + np.exp(-(x @ model.weight + model.bias))) - y)) + 2 * 5.0 / 300 * (change.T @ (change @ model.weight))
    start = np.abs(x.T @ (share * (1 / (1 + np.exp(-np.log(60.5 / 240.5))) - y))).max()
    held, toxic = x.sum(0), x[y > 0].sum(0)
    differs = np.abs(toxic - held * 0.2) / np.sqrt(np.maximum(held * 0.2 * 0.8, 1e-9))
    cost = 0.003 * 4.5 * start / np.maximum(differs, 1e-3)
    used = model.weight != 0
    assert (np.abs(slope[~used]) <= 1.02 * cost[~used] + 1e-6).all() and np.abs(slope[used] + np.sign(model.weight[used]) * cost[used]).max() < 2e-3


def test_nothing_to_learn_from():
    lists = lambda n: pa.array([[] for _ in range(n)], pa.list_(pa.int32()))
    for y in (np.zeros(0, np.float32), np.ones(4, np.float32), np.zeros(4, np.float32)):
        model = toxicity.Model().fit(lists(len(y)), lists(len(y)), lists(len(y)), y)
        assert model.pairs == 0 and 0 < model.predict(["any", ""])[0] < 1


def planted(text, rng):
    """The text with a mention of some group put between two of its words."""
    words = (text or "").split(" ")
    words.insert(rng.randrange(len(words) + 1), rng.choice(["muslims", "women", "immigrants", "gay", "frauen", "juifs", "mujeres"]))
    return " ".join(words)


@pytest.mark.skipif(not os.path.exists(REAL), reason="needs the given tables")
def test_penalty_lowers_false_positives_on_neutral_mentions_in_documents(spark):
    """Training labels are biased: most toxic documents mention a group. Held-out clean ones mention one, too."""
    docs = spark.read.parquet(f"{REAL}/documents.parquet").join(spark.read.parquet(f"{REAL}/labels.parquet"), "doc_id").withColumn("held", labelled.fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT)
    rows = docs.select("doc_id", "text", "toxic", "held").orderBy("doc_id").collect()
    rng = random.Random(32)
    train = [r for r in rows if not r.held]
    texts = [planted(r.text, rng) if rng.random() < (0.8 if r.toxic else 0.02) else r.text for r in train]
    y = np.array([r.toxic for r in train], np.float32)
    neutral = [planted(r.text, rng) for r in rows if r.held and not r.toxic]
    found, added, lacked, swaps = examples(texts)
    plain = toxicity.Model(0.0).fit(found, added, lacked, y, np.array(swaps))
    fair = toxicity.Model(10.0).fit(found, added, lacked, y, np.array(swaps))
    assert fair.pairs > 250 and fair.swaps > 20
    rate = lambda m: float((m.predict(neutral) >= 0.5).mean())
    assert rate(plain) > 0.1 and rate(fair) < 0.5 * rate(plain)
    toxic = [r.text for r in rows if r.held and r.toxic]
    assert (fair.predict(toxic) >= 0.5).mean() >= (plain.predict(toxic) >= 0.5).mean() - 0.1


@pytest.mark.parametrize("operator", [quality.score_quality, toxicity.score_toxicity])
def test_long_texts_nulls_and_repeated_ids(spark, operator):
    rng = random.Random(33)
    docs = [(i, " ".join(rng.choices("alpha beta gamma delta".split(), k=30)) + (" vile" * 3 if i % 3 == 0 else ""), "x") for i in range(90)]
    docs += [(200, "word " * 200_000 + "vile", "x"), (201, None, "x"), (None, "vile", "x"), (3, "another text", "x"), (3, docs[3][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(90)] + [(200, 0, 1)], "doc_id long, quality int, toxic int")
    found = operator(df, labels).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    rows = labelled.sample(df, labels, "toxic", folds=3, held_out=1, bound=20)
    assert rows.count() == rows.select("_id").distinct().count() <= 20 and rows.filter("_id = 3").select(F.min("text")).first()[0] in (None, docs[3][1], "another text")
