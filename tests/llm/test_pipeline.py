import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check as check_pieces

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        after, seen[name] = docs.collect(), docs.count()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.95 * len(good) and {tuple(r) for r in after} <= {tuple(r) for r in before}
        elif name == "line_dedup":
            want = {d: t for d, t, _, _ in brute_lines([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_duplicates":
            want = {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80) if d == c}
            assert {r["doc_id"] for r in after} == want
        elif name == "mixing":
            assert Counter(map(tuple, after)) == Counter(map(tuple, before))
        else:
            check_pieces(after, {r["doc_id"]: r["text"] for r in before})
            files = {r["order"] >> 40 for r in after}
            assert files == {int(p.name[5:10]) for p in (tmp_path / "mixing").glob("part-*.parquet") if spark.read.parquet(str(p)).count()}
    assert corpus_pipeline.run(spark, FOLDER).count() == seen["packing"]


def test_pipeline_stages_take_nulls_and_empty_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", 0), (None, "a b c", "en", "s", 5), (2, "", "", "", 0)], schema)
    for k, docs in enumerate((odd, odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
