import random

import pytest
from pyspark.sql import functions as F

from parquill.functions import chrf

VECTORS = [("ab", "abc", 700 / 33), ("abc", "abd", 700 / 36), ("abc", "ab", 700 / 24), ("abcdef", "abcdef", 100.0), ("", "abc", 0.0), ("abc", "", 0.0), ("", "", 0.0), ("ab", "ab", 100 / 3)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(VECTORS)], "id int, h string, r string")
    return chrf.segment_scores(rows, "h", "r").orderBy("id")


def test_known_segments(scored):
    assert [r["score"] for r in scored.collect()] == pytest.approx([v for _, _, v in VECTORS])


def test_corpus_pools_counts(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("abcdef", "abcdef")], "h string, r string")
    out = chrf.segment_scores(rows, "h", "r")
    assert sorted(r["score"] for r in out.collect()) == pytest.approx([100 / 3, 100.0])
    assert chrf.pooled(out).first().asDict() == {"n": 2, "corpus_score": pytest.approx(100.0)}


def test_composed_and_decomposed_are_equal(spark):
    import unicodedata

    word = "번역 품질을 잰다"
    rows = spark.createDataFrame([(unicodedata.normalize("NFD", word), word.replace(" ", ""))], "h string, r string")
    assert chrf.segment_scores(rows, "h", "r").first()["score"] == pytest.approx(100.0)


def test_relational_form_counts_the_same(spark):
    draw = random.Random(5)
    pairs = [(i, "".join(draw.choice("abcй ") for _ in range(draw.randrange(0, 14))), "".join(draw.choice("abcй ") for _ in range(draw.randrange(0, 14)))) for i in range(60)]
    rows = spark.createDataFrame(pairs, "id int, h string, r string")
    slow = {(r["id"], r["n"]): (r["matches"], r["hyp"], r["ref"]) for r in chrf.relational_counts(rows, "id", "h", "r").collect()}
    for row in rows.withColumn("c", chrf.counts(F.col("h"), F.col("r"))).collect():
        for n in range(6):
            assert slow.get((row["id"], n + 1), (0, 0, 0)) == (row["c"]["m"][n], row["c"]["h"][n], row["c"]["r"][n])


def test_empty_table(spark):
    rows = spark.createDataFrame([], "h string, r string")
    assert chrf.pooled(chrf.segment_scores(rows, "h", "r")).first()["corpus_score"] == 0.0


def test_parameters_name_the_metric():
    assert chrf.parameters()["char_order"] == 6 and chrf.parameters()["word_order"] == 0
