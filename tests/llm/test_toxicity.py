import random
import zlib

import numpy as np
import pytest

from parquill.llm.gbt import BoostedTrees, Isotonic, auc, logistic
from parquill.llm.toxicity import Featurizer, plain, toxicity


def corpus(n=1500, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "on", "shi") for b in ("ka", "ver", "st", "nu", "ble", "")]
    rows = []
    for i in range(n):
        text, bad = [draw.choice(words) for _ in range(draw.randrange(5, 120))], draw.random() < 0.2
        for _ in range(draw.randrange(2, 6) if bad else 0):
            text[draw.randrange(len(text))] = draw.choice(["idiot", "zorgon", "zorgonta", "1d10t", "scum,"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows], "doc_id long, text string, score double, label int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    y = np.array([truth[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) > 0.98
    assert np.mean([r["predicted"] for r in held] == y) > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()} for labels in ([(i, y) for i, _, y in rows], turned))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (3, "x" * 200_000), (3, "a"), (3, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, None), (3, 7), (None, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert toxicity(docs.limit(0), labels).count() == 0
    assert toxicity(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_features():
    assert plain("1D10T!!") == ("idiot", True) and plain("stuuuupid") == ("stuupid", True) and plain("Word.") == ("word", False) and plain("...") == ("", False)
    row = dict(zip(Featurizer.NAMES, Featurizer({"zorg-": 3.0})("You are an idiot and zorgons SHOUT!".encode()), strict=True))
    assert row["hits"] == pytest.approx(np.log1p(2)) and row["near"] > 0 and row["second"] == 1 / 7 and row["capital_words"] == 1 / 7
    assert Featurizer({})(b"") == [0.0] * len(Featurizer.NAMES)


def test_models():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (draw.random(3000) < 0.05)).astype(float)
    model = BoostedTrees(trees=80).fit(x[:2000], y[:2000])
    assert auc(model.margin(x[2000:]), y[2000:]) > 0.9
    curve = Isotonic().fit(model.margin(x[:2000]), y[:2000])
    p = curve(np.sort(model.margin(x)))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1
    w = logistic(x, (x[:, 0] + 0.1 > 0).astype(float))
    assert w[0] > 2 and abs(w[1]) < 0.5
    for few in (np.zeros((0, 2)), np.ones((3, 2))):
        one = BoostedTrees().fit(few, np.zeros(len(few)))
        assert len(set(one.margin(np.random.default_rng(2).normal(size=(5, 2))))) == 1
    assert Isotonic().fit(np.zeros(0), np.zeros(0))(np.array([1.0]))[0] == 0.5
