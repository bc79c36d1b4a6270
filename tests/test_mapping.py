import random

import pytest
from pyspark.sql import functions as F

from parquill.operators import mapping


def loop(ok, limit):
    """The breaker, chunk by chunk."""
    out, row, stopped = [], 0, False
    for good in ok:
        out.append(stopped)
        row = 0 if good and not stopped else row + 1
        stopped = stopped or row >= max(1, limit)
    return out


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_breaker_equals_a_loop(spark, limit):
    draw = random.Random(limit)
    docs = [[draw.random() < 0.6 for _ in range(draw.randrange(1, 14))] for _ in range(40)]
    rows = spark.createDataFrame([(d, i, ok) for d, oks in enumerate(docs) for i, ok in enumerate(oks)], "doc int, index int, ok boolean")
    got = mapping.breaker(rows, "doc", limit=limit).orderBy("doc", "index").collect()
    assert [r["aborted"] for r in got] == [x for oks in docs for x in loop(oks, limit)]


def make_failing():
    def translate(text):
        if "плохо" in text:
            raise ValueError("плохо")
        return f" {text.upper()} "

    return translate


TEXT = "\n\n".join(["хорошо", "плохо", "ещё", *["плохо"] * 3, "конец"])


def test_both_ways_agree(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, "хорошо\n"), (4, None)], "doc_id int, text string")
    one = mapping.translate_documents(docs, mapping.translator(make_failing), ident="doc_id", text="text", budget=50)
    other = docs.select("doc_id", mapping.translate_in_order(make_failing, budget=50)(F.col("text")).alias("r")).select("doc_id", "r.*")
    a, b = ({r["doc_id"]: r.asDict() for r in d.collect()} for d in (one, other))
    assert a == b
    assert a[1]["chunks_failed"] == [1, 3, 4, 5, 6] and a[1]["aborted"] and a[1]["chunks_total"] == 7
    assert a[1]["text"].startswith("ХОРОШО\n\n[[UNTRANSLATED chunk=1]]\nплохо\n[[/UNTRANSLATED chunk=1]]\n\nЕЩЁ")
    assert a[2]["text"] == "" and a[3]["text"] == "ХОРОШО\n" and not a[3]["aborted"]


def test_retries(spark):
    def make():
        tries = {}

        def translate(text):
            tries[text] = tries.get(text, 0) + 1
            if tries[text] < 3:
                raise RuntimeError("later")
            return "да"

        return translate

    rows = spark.createDataFrame([("a",)], "t string").coalesce(1)
    for retries, ok in ((1, False), (2, True)):
        got = rows.select(mapping.translator(make, retries)(F.col("t")).alias("r")).first()["r"]
        assert got["ok"] == ok and (ok or got["error"] == "RuntimeError: later")


def test_token_folding_and_guards(spark):
    rows = spark.createDataFrame([(1, [("a", None), ("b", "stop")]), (2, [("a", "length")]), (3, [("<t>x", "length")]), (4, [])], "i int, s array<struct<text:string,finish_reason:string>>")
    text, reason = mapping.fold_tokens(F.col("s"))
    got = rows.select("i", text.alias("t"), mapping.completion_problem(text, reason, ["<t>"]).alias("p")).orderBy("i").collect()
    assert [(r["t"], r["p"]) for r in got] == [("ab", None), ("a", "truncated"), ("<t>x", "reasoning"), ("", "truncated")]
