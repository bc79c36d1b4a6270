import json

import pytest
from pyspark.sql import functions as F

from parquill.errors import RecordShapeError, SchemaError, SplitLayoutError
from parquill.operators import records
from parquill.plans.validate import validate_schema, validate_split_dir, validate_training_file

SHAPE = records.PromptShape()
CHAT = {"messages": [*SHAPE.messages("да"), {"role": "assistant", "content": "네"}]}


def jsonl(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


CASES = [
    (CHAT, "chat", None), ({"prompt": "a", "completion": "b"}, "completions", None), ({"text": "a"}, "text", None), ({"text": "a", "more": 1}, "text", None),
    ("{broken", None, "not JSON"), ("3", None, "not an object"), ("[1]", None, "not an object"), ({"other": 1}, None, "no schema"), ({"text": 5}, None, "no schema"), ({"prompt": "a"}, None, "no schema"),
    ({"messages": []}, None, "messages not a non-empty list"), ({"messages": "x"}, None, "messages not a non-empty list"), ({"messages": [], "text": "a"}, None, "messages not a non-empty list"),
    ({"messages": [{"role": "user"}]}, None, "message keys"), ({"messages": [{"role": "user", "content": "a", "x": 1}]}, None, "message keys"), ({"messages": [1]}, None, "message keys"),
    ({"messages": [{"role": "user", "content": 5}]}, None, "message types"), ({"messages": [{"role": "robot", "content": "a"}]}, None, "message roles"),
]


def test_classification(spark):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, (r, _, _) in enumerate(CASES)], "i int, raw string")
    schema, problem = records.classify(F.col("raw"))
    got = rows.select("i", schema.alias("s"), problem.alias("p")).orderBy("i").collect()
    assert [(r["s"], r["p"]) for r in got] == [(s, p) for _, s, p in CASES]


def test_round_trip_and_drift(spark):
    rows = spark.createDataFrame([(1, "да", "네"), (2, f"x{SHAPE.mark}", "네")], "i int, s string, t string")
    built = rows.withColumn("m", records.build_record(F.col("s"), F.col("t"), SHAPE))
    assert [r["m"] is None for r in built.orderBy("i").collect()] == [False, True]
    messages = records.messages_of(records.render_record(F.col("m")))
    s, t = records.parse_record(messages, SHAPE)
    row = built.filter("i = 1").select(s.alias("s"), t.alias("t"), records.record_problem(messages, SHAPE).alias("p"), records.render_record(F.col("m")).alias("line")).first()
    assert (row["s"], row["t"], row["p"]) == ("да", "네", None) and json.loads(row["line"]) == CHAT
    assert row["line"] == json.dumps(CHAT, ensure_ascii=False, separators=(",", ":"))


def test_fingerprint_is_the_digest_of_the_rendered_shape(spark):
    column = F.sha2(F.to_json(SHAPE.column(F.lit(SHAPE.mark))), 256)
    assert spark.range(1).select(column).first()[0] == SHAPE.fingerprint()
    assert records.PromptShape("other").fingerprint() != SHAPE.fingerprint()


def test_files(spark, tmp_path):
    assert validate_schema(spark, jsonl(tmp_path / "t.jsonl", [{"text": "a"}, "", {"text": "b"}])) == "text"
    with pytest.raises(SchemaError, match=":3: completions row in a text file"):
        validate_schema(spark, jsonl(tmp_path / "m.jsonl", [{"text": "a"}, "", {"prompt": "a", "completion": "b"}]))
    with pytest.raises(SchemaError, match=":2: not JSON"):
        validate_schema(spark, jsonl(tmp_path / "b.jsonl", [{"text": "a"}, "{"]))
    with pytest.raises(SchemaError, match="no records"):
        validate_schema(spark, jsonl(tmp_path / "e.jsonl", [""]))
    with pytest.raises(SchemaError, match="no such file"):
        validate_schema(spark, str(tmp_path / "none.jsonl"))


def test_training_files_need_the_prompt_shape(spark, tmp_path):
    assert validate_training_file(spark, jsonl(tmp_path / "a.jsonl", [CHAT, CHAT]), SHAPE) == 2
    with pytest.raises(SchemaError, match="text rows"):
        validate_training_file(spark, jsonl(tmp_path / "b.jsonl", [{"text": "a"}]), SHAPE)
    other = {"messages": [{"role": "system", "content": "x"}, *CHAT["messages"][1:]]}
    with pytest.raises(RecordShapeError, match=":2: message 0"):
        validate_training_file(spark, jsonl(tmp_path / "c.jsonl", [CHAT, other]), SHAPE)


def test_split_directories(spark, tmp_path):
    with pytest.raises(SplitLayoutError):
        validate_split_dir(spark, str(tmp_path))
    jsonl(tmp_path / "train.jsonl", [CHAT])
    report = validate_split_dir(spark, str(tmp_path))
    assert report.rows == {"train.jsonl": 1} and "valid.jsonl" in report.notices[0]
    jsonl(tmp_path / "test.jsonl", [{"text": "a"}])
    with pytest.raises(SchemaError):
        validate_split_dir(spark, str(tmp_path))
