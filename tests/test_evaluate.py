import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from parquill import adapters
from parquill.errors import ConfoundedComparisonError, DatasetError, DecodingMismatchError, EvaluationError, RecordError, SplitIntegrityError
from parquill.operators import compare, leakage, mapping, records
from parquill.plans import evaluate
from parquill.sources import readers

SHAPE = records.PromptShape()


def arm(spark, rows):
    return spark.createDataFrame([(i, o, float(s)) for i, (o, s) in enumerate(rows)], "line int, output string, score double")


def both(spark, base, adapter):
    return compare.join_arms(arm(spark, base), arm(spark, adapter))


def test_verdicts_follow_their_precedence(spark):
    base, up, same = [("a", 10)] * 4, [("b", 20)] * 4, [("a", 10)] * 3 + [("b", 90)]
    rows = both(spark, base, up)
    assert compare.compare(rows, 10, 20).first()["verdict"] == "improved"
    assert compare.compare(rows, 20, 10).first()["verdict"] == "regressed"
    assert compare.compare(rows, 10, 11).first()["verdict"] == "indistinguishable"
    assert compare.compare(rows, 10, 20, spreads=[None, 10.0]).first().asDict()["floor_bases"] == {"convention": 1.0, "empirical-repeat-spread": 10.0}
    assert compare.compare(rows, 10, 20, spreads=[None, 10.0]).first()["verdict"] == "indistinguishable"
    assert compare.compare(rows, 10, 20, confounded=True).first()["verdict"] == "unavailable"
    few = compare.compare(both(spark, base, same), 10, 30).first()
    assert (few["verdict"], few["wins"], few["losses"], few["ties"]) == ("indistinguishable", 1, 0, 3) and few["note"]
    with pytest.raises(DecodingMismatchError):
        compare.compare(rows, 1, 2, fingerprints=("a", "b"))
    with pytest.raises(DatasetError):
        both(spark, base, up[:3])


def test_bootstrap_only_widens(spark):
    draw = random.Random(1)
    mixed = both(spark, [("a", 0)] * 12, [("b", draw.choice([-3, 3])) for _ in range(12)])
    sure = both(spark, [("a", 0)] * 12, [("b", 5)] * 12)
    assert compare.bootstrap_floor(mixed, 0.4, 7, 200).first()["floor"] == 0.4
    assert compare.bootstrap_floor(sure, 5.0, 7, 200).first()["floor"] == 0.0
    assert compare.bootstrap_floor(both(spark, [("a", 0)], [("b", 5)]), 5.0, 7, 50).first()["floor"] == 0.0
    assert compare.bootstrap_floor(mixed, 0.4, 7, 200).first() == compare.bootstrap_floor(mixed, 0.4, 7, 200).first()


def test_spread_needs_two_repeats(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "arm string, corpus_score double")
    assert {r["arm"]: r["spread"] for r in compare.spread(rows).collect()} == {"a": 2.0, "b": None}


def test_leaks_are_found_by_canonical_text(spark):
    test = spark.createDataFrame([(1, "Привет  мир", "a"), (2, "новое", "b")], "line int, source string, target string")
    train = spark.createDataFrame([(5, "привет мир", "x"), (3, "ПРИВЕТ МИР", "A")], "line int, source string, target string")
    assert [tuple(r) for r in leakage.overlaps(test, train).collect()] == [(1, 3)]
    assert [tuple(r) for r in leakage.overlaps(test, train, pair=True).collect()] == [(1, 3)]
    summary = {r["kind"]: (r["hits"], r["line"], r["other_line"]) for r in leakage.overlap_summary(test, {"train": train}).collect()}
    assert summary == {"source": (1, 1, 3), "pair": (1, 1, 3)}
    left = leakage.without_leaked(train.withColumnRenamed("source", "text"), test.withColumnRenamed("source", "text"))
    assert left.count() == 0


def test_containments_equal_a_search(spark):
    draw = random.Random(2)
    word = lambda: draw.choice(["ab", "b", "abc", "Ca"])
    docs = [(i, " ".join(word() for _ in range(draw.randrange(0, 25)))) for i in range(120)]
    items = [(i, " ".join(word() for _ in range(draw.randrange(0, 9)))) for i in range(40)]
    got = leakage.containments(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, d) for d, t in docs for i, x in items if x and x.lower() in t.lower()}


def jsonl(path, pairs):
    rows = [{"messages": [*SHAPE.messages(s), {"role": "assistant", "content": t}]} for s, t in pairs]
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def fake(suffix):
    def make():
        return lambda text: f"{text}{suffix}"

    return mapping.translator(make)


PAIRS = [(f"предложение номер {i}", f"предложение номер {i} перевод") for i in range(4)]
ARMS = {"base": fake(" x"), "adapter": fake(" перевод")}
CLOCK = {"clock": lambda: datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)}


@pytest.fixture
def config(tmp_path):
    (tmp_path / "adapter").mkdir()
    return evaluate.EvaluationConfig(test_file=jsonl(tmp_path / "test.jsonl", PAIRS), adapter_path=str(tmp_path / "adapter"), bootstrap_seed=3, out_dir=str(tmp_path / "eval"))


def test_evaluation_end_to_end(spark, config, tmp_path):
    record = evaluate.evaluate_pair(spark, config, ARMS, **CLOCK)
    assert record["comparison"]["verdict"] == "improved" and record["arms"]["adapter"]["corpus_chrf"] == pytest.approx(100.0)
    assert record["run_id"].startswith("20260102T030405Z-") and record["test_set"]["n_scored"] == 4
    path = evaluate.write_run(record, config.out_dir)
    assert readers.read_run(spark, str(path)) == json.loads(path.read_text(encoding="utf-8"))
    evaluate.write_run(record, config.out_dir)
    assert len((tmp_path / "eval/index.jsonl").read_text().splitlines()) == 2
    assert "verdict: improved" in evaluate.render_summary(record)


def test_limits_and_missing_adapters(spark, config):
    from dataclasses import replace

    assert evaluate.evaluate_pair(spark, replace(config, limit=2), ARMS)["test_set"]["n_scored"] == 2
    with pytest.raises(EvaluationError):
        evaluate.evaluate_pair(spark, replace(config, limit=0), ARMS)
    with pytest.raises(EvaluationError):
        evaluate.evaluate_pair(spark, replace(config, adapter_path=" "), ARMS)


def test_leaked_splits_are_refused(spark, config, tmp_path):
    jsonl(tmp_path / "train.jsonl", [("другое", "x"), (PAIRS[1][0].upper(), "y")])
    with pytest.raises(SplitIntegrityError, match=r"1 shared source\(s\), first at .*:2 = train.jsonl:2"):
        evaluate.evaluate_pair(spark, config, ARMS)


def test_foreign_bases_are_confounded(spark, config):
    from dataclasses import replace

    adapters.write_provenance(config.adapter_path, adapters.Provenance("other", SHAPE.fingerprint()))
    with pytest.raises(ConfoundedComparisonError):
        evaluate.evaluate_pair(spark, config, ARMS)
    assert evaluate.evaluate_pair(spark, replace(config, allow_provenance_mismatch=True), ARMS)["comparison"]["verdict"] == "unavailable"


def test_incomplete_records_are_refused(spark, tmp_path):
    good = dict.fromkeys(readers.RUN_KEYS, 1) | {"comparison": {"verdict": "improved"}}
    for bad in ("{", "[1]", json.dumps({k: v for k, v in good.items() if k != "scores"}), json.dumps(good | {"comparison": {"verdict": "great"}})):
        (tmp_path / "r.json").write_text(bad)
        with pytest.raises(RecordError):
            readers.read_run(spark, str(tmp_path / "r.json"))


def test_runs_compare_only_where_they_may(spark):
    kind = "run_id string, delta double, test_sha256 string, test_limit int, prompt_shape_fingerprint string"
    a = spark.createDataFrame([("a", 1.0, "s", None, "p")], kind)
    b = spark.createDataFrame([("b", 3.0, "s", None, "p"), ("c", 3.0, "t", 5, "p")], kind)
    got = {r["second_run"]: (r["comparable"], r["reasons"], r["delta"]) for r in compare.compare_runs(a, b).collect()}
    assert got == {"b": (True, [], 2.0), "c": (False, ["test_sha256", "test_limit"], None)}


def test_split_digest_needs_line_order_only(spark):
    import hashlib

    rows = spark.createDataFrame([(2, "B", "y"), (1, " A  a", "x")], "line int, source string, target string")
    assert leakage.split_digest(rows).first()["digest"] == hashlib.sha256("a a\x1fx\nb\x1fy".encode()).hexdigest()
    assert rows.select(F.count("*")).first()[0] == 2


def test_floors_take_the_largest_base(spark):
    spreads = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 2.5)], "arm string, spread double")
    assert compare.floors(spreads).first()["floor"] == 2.5 and compare.floors(spreads, 7.0).first().asDict() == {"floor": 7.0, "floor_bases": {"convention": 1.0, "empirical-repeat-spread": 2.5, "bootstrap-ci": 7.0}}
    assert compare.floors(spreads.filter("arm = 'b'")).first().asDict() == {"floor": 1.0, "floor_bases": {"convention": 1.0}}


def test_several_first_records_need_a_key(spark):
    kind = "run_id string, delta double, test_sha256 string, test_limit int, prompt_shape_fingerprint string"
    rows = spark.createDataFrame([("a", 1.0, "s", None, "p"), ("b", 1.0, "s", None, "p")], kind)
    with pytest.raises(ValueError):
        compare.compare_runs(rows, rows)
    assert compare.compare_runs(rows.limit(0), rows).count() == 0


def test_missing_and_empty_splits_are_typed_errors(spark, tmp_path):
    from parquill.errors import SchemaError

    (tmp_path / "empty.jsonl").write_text("\n")
    for name in ("none.jsonl", "empty.jsonl"):
        with pytest.raises(SchemaError):
            readers.load_split(spark, str(tmp_path / name), SHAPE)
