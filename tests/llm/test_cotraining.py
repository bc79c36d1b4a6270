import random

import numpy as np

from parquill.llm.cotraining import CONTENT, META, CoTraining, content, keep_good, metadata, quality
from parquill.llm.gbt import auc

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=900, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(1, 9)))
    rows = []
    for i in range(n):
        good = draw.random() < 0.8
        words = [word() for _ in range(draw.randrange(20, 200))]
        text = " ".join(words) if good else " ".join(w + draw.choice(["***", "$$$", "&&&"]) for w in words)
        rows.append((i, text, "en", f"s{draw.randrange(3) if good else draw.randrange(2, 5)}", len(text), "x", int(good)))
    return rows


def test_views_and_their_sum_tell_quality(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:6] for r in rows], KIND).repartition(3)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows if r[0] % 3 == 0], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    y = np.array([rows[r["doc_id"]][6] for r in got])
    scores = {c: auc(np.array([r[c] for r in got]), y) for c in ("score", "content_score", "metadata_score")}
    assert scores["score"] > 0.99 and scores["content_score"] > 0.99 and scores["metadata_score"] > 0.75
    assert np.mean(np.array([r["kept"] for r in got]) == (y == 1)) > 0.98
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_views_teach_each_other():
    draw = np.random.default_rng(2)
    y = (draw.random(4000) < 0.5).astype(float)
    a = y[:, None] * 2 + draw.normal(size=(4000, 1)) * 0.4  # sure
    b = np.hstack([y[:, None] + draw.normal(size=(4000, 1)), draw.normal(size=(4000, 1))])  # vague
    model = CoTraining().fit((a[:120], b[:120]), y[:120], (a[120:3000], b[120:3000]))
    alone = CoTraining(rounds=0).fit((a[:120], b[:120]), y[:120], (a[120:3000], b[120:3000]))
    assert model.given[1] > 500 and alone.given == [0, 0]
    test = (a[3000:], b[3000:])
    assert auc(model.models[1].margin(test[1]), y[3000:]) >= auc(alone.models[1].margin(test[1]), y[3000:]) - 0.01
    assert auc(model.score(test)[0], y[3000:]) > 0.98


def test_edges(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "", "", 0, "x"), (None, "a b", "en", "s", 3, "x"), (3, "w" * 100_000, "en", "s", 1, "x"), (3, "w", "en", "s", 1, "x"), (3, "w", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 5)], "doc_id long, quality int")
    assert quality(docs, labels).count() == 6 and keep_good(docs, labels.limit(0)).count() in (0, 6)
    assert quality(docs.limit(0), labels).count() == 0 == keep_good(docs.limit(0), labels).count()
    assert len(content(b"")) == len(content(b"a b")) == CONTENT and len(metadata(b"", None, None)) == META
