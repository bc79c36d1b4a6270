"""The registered queries on the smallest tables, against plain Python."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parquill.llm import queries
from tests.llm.test_packing import reference
from tests.llm.test_quality_rules import brute as base_counts
from tests.llm.test_secrets import brute as base_spans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_mixing(spark, docs):
    rows = queries.op2_mixing(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter((d, r["source"]) for d, r in docs.items())
    slots = defaultdict(list)
    for r in rows:
        slots[r["mix_slot"]].append(r)
    assert sorted(slots) == list(range(len(slots)))
    for own in slots.values():
        assert len({r["source"] for r in own}) == 1 and sorted(r["mix_row"] for r in own) == list(range(len(own)))


def test_packing(spark, docs):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in queries.op3_packing(spark, FOLDER).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == docs.keys()
    for d, pieces in by_doc.items():
        ids, at = reference(docs[d]["text"]), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            cut = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(cut))
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_toxicity(spark, docs):
    rows = queries.op5_toxicity(spark, FOLDER).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_quality_rules(spark, docs):
    for r in queries.op6_quality_rules(spark, FOLDER).collect():
        want = base_counts(docs[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_secrets(spark, docs):
    rows = queries.op8_secrets(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_spans(docs[r["doc_id"]]["text"])
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert tuple(r[f"n_{k}"] for k in ("assign", "access", "hex")) == tuple(sum(x[1] == k for x in base) for k in ("assign", "access", "hex"))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [s for s in spans if s[0] != "crf"] == [[k, str(a), str(b)] for a, k, b in base]
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def test_quality(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, FOLDER).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys()) and all(r["kept"] == (r["score"] >= 0.5) for r in rows)
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert sum(good) >= 0.95 * len(good)


def test_held_out_rows_are_told_apart(spark):
    """Both classifiers on rows that they never saw."""
    from pyspark.sql import functions as F

    from parquill.llm import cotraining, toxicity

    folder = "/root/testdata/sf0.01"
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = cotraining.quality(documents, labels.filter(~held)).filter(held).join(labels, "doc_id").filter("quality in (0, 1)").collect()
    assert len(good) > 50 and sum(r["kept"] == (r["quality"] == 1) for r in good) >= 0.95 * len(good)
    toxic = toxicity.toxicity(documents, labels).filter("held_out").join(labels, "doc_id").filter("toxic in (0, 1)").collect()
    assert len(toxic) > 50 and sum(r["predicted"] == r["toxic"] for r in toxic) >= 0.95 * len(toxic)
