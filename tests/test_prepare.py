import json
import random

import pytest

from parquill.errors import InputError, OutputExistsError, OutputPathError, PrepareError
from parquill.operators import dedupe, split
from parquill.plans.prepare import PrepareConfig, prepare_splits, render_report
from parquill.plans.validate import validate_split_dir
from parquill.sources import readers, sinks


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def numbered(n):
    return [f"источник {i} ||| 번역 {i}" for i in range(n)]


def test_reader_reports_each_bad_line(spark, tmp_path):
    path = write(tmp_path / "a.txt", ["# comment", "", "да ||| 네", "no delimiter", "a ||| b ||| c", " ||| x", "x ||| ", "д ||||네"])
    rows = readers.read_pairs(spark, [path]).orderBy("line").collect()
    assert [(r["line"], r["problem"]) for r in rows] == [(3, None), (4, "delimiter"), (5, "delimiter"), (6, "left"), (7, "right"), (8, None)]
    assert (rows[0]["source"], rows[0]["target"]) == ("да", "네") and rows[-1]["target"] == "|네"


def test_reader_takes_bom_and_line_ends_and_refuses_other_bytes(spark, tmp_path):
    (tmp_path / "bom.txt").write_bytes("﻿да ||| 네\r\nнет ||| 아니요\r\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa ||| x\n")
    rows = readers.read_pairs(spark, [str(tmp_path / "bom.txt"), str(tmp_path / "bad.txt")]).orderBy("file", "line").collect()
    assert [(r["line"], r["source"], r["problem"]) for r in rows] == [(1, "да", None), (2, "нет", None), (0, None, "encoding")]


def test_inputs_are_ordered(tmp_path):
    for name in ("b.txt", "a.txt", "c.md"):
        (tmp_path / name).write_text("x")
    files, skipped = readers.resolve_inputs([tmp_path])
    assert [f[-5:] for f in files] == ["a.txt", "b.txt"] and skipped[0].endswith("c.md")
    with pytest.raises(InputError):
        readers.resolve_inputs([tmp_path / "none"])


def loop(rows, allow):
    """The order-dependent rule, row by row."""
    seen, first, out = set(), {}, []
    for i, s, t in rows:
        if (s, t) in seen:
            out.append((i, "duplicate"))
        elif s in first and not allow:
            out.append((i, "problem"))
        else:
            out.append((i, "conflict" if s in first else "keep"))
            seen.add((s, t))
            first.setdefault(s, t)
    return out


@pytest.mark.parametrize("allow", [True, False])
def test_duplicates_equal_a_loop(spark, allow):
    draw = random.Random(3)
    rows = [(i, draw.choice("abcd"), draw.choice("xyz")) for i in range(80)]
    frame = spark.createDataFrame(draw.sample(rows, len(rows)), "i int, source_key string, target_key string")
    got = dedupe.mark_duplicates(frame, ["i"], allow_conflicts=allow)
    assert [(r["i"], r["status"]) for r in got.orderBy("i").collect()] == loop(rows, allow)


def greedy(groups, plan):
    """The greedy split over (hash, key, size) in order."""
    at, held, out = 0, 0, {}
    for _, key, size in sorted(groups):
        while at < len(plan) - 1 and held >= plan[at][1]:
            at, held = at + 1, 0
        out[key] = plan[at][0]
        held += size
    return out


@pytest.mark.parametrize("seed", range(4))
def test_split_equals_a_loop(spark, seed):
    import hashlib

    draw = random.Random(seed)
    rows = [(f"k{draw.randrange(25)}", i) for i in range(70)]
    got = {r["source_key"]: r["split"] for r in split.assign_splits(spark.createDataFrame(rows, "source_key string, i int"), seed=seed, valid_fraction=0.2, test_fraction=0.1).collect()}
    groups = [(hashlib.sha256(f"{seed}\x1f{k}".encode()).hexdigest(), k, sum(a == k for a, _ in rows)) for k in {k for k, _ in rows}]
    assert got == greedy(groups, split.SplitPlan.of(70, 0.2, 0.1).sizes)


@pytest.mark.parametrize("fractions", [(0.6, 0.5), (-0.1, 0.1), (1.0, 0.0)])
def test_fractions_are_checked(fractions):
    with pytest.raises(PrepareError):
        split.SplitPlan.of(100, *fractions)


def test_splits_that_would_be_empty_are_refused():
    with pytest.raises(PrepareError, match="10 rows"):
        split.SplitPlan.of(4, 0.1, 0.1)
    assert dict(split.SplitPlan.of(10, 0.0, 0.1).sizes) == {"train": 9, "test": 1}


def test_prepare_writes_what_validates(spark, tmp_path):
    source = write(tmp_path / "in.txt", [*numbered(20), "источник 1 ||| 번역 1"])
    out = tmp_path / "out"
    result = prepare_splits(spark, PrepareConfig((source,), str(out)))
    assert result.manifest["counts"] == {"pairs_read": 21, "duplicates_dropped": 1, "unique_sources": 20, "train": 16, "valid": 2, "test": 2}
    assert validate_split_dir(spark, str(out)).rows == {"train.jsonl": 16, "valid.jsonl": 2, "test.jsonl": 2}
    line = json.loads((out / "train.jsonl").read_text(encoding="utf-8").splitlines()[0])
    assert [m["role"] for m in line["messages"]] == ["system", "user", "assistant"]
    assert "16 rows" in render_report(result) and len(result.duplicates) == 1
    with pytest.raises(OutputExistsError, match="seed 0"):
        prepare_splits(spark, PrepareConfig((source,), str(out)))
    before = (out / "train.jsonl").read_bytes()
    lines = (tmp_path / "in.txt").read_text(encoding="utf-8").splitlines()
    again = write(tmp_path / "again.txt", lines[::-1])
    prepare_splits(spark, PrepareConfig((again,), str(out), valid_fraction=0.1, overwrite=True))
    assert (out / "train.jsonl").read_bytes() == before  # the corpus's order does not matter
    prepare_splits(spark, PrepareConfig((again,), str(out), valid_fraction=0.0, overwrite=True))
    assert not (out / "valid.jsonl").exists()


def test_nothing_is_written_while_rows_are_bad(spark, tmp_path):
    source = write(tmp_path / "in.txt", [*numbered(10), "источник 1 ||| 다른 번역", "x"])
    with pytest.raises(InputError) as error:
        prepare_splits(spark, PrepareConfig((source,), str(tmp_path / "out")))
    assert len(error.value.problems) == 2 and not (tmp_path / "out").exists()
    with pytest.raises(InputError):
        prepare_splits(spark, PrepareConfig((write(tmp_path / "none.txt", ["# only"]),), str(tmp_path / "out")))


def test_output_is_never_inside_protected_folders(tmp_path):
    with pytest.raises(OutputPathError):
        sinks.resolve_output(tmp_path / "data/raw/x", tmp_path)
    assert sinks.resolve_output(tmp_path / "data/splits", tmp_path)


def test_no_row_of_a_split_goes_through_the_driver(spark, tmp_path, monkeypatch):
    import hashlib

    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    source = write(tmp_path / "in.txt", numbered(300))
    result = prepare_splits(spark, PrepareConfig((source,), str(tmp_path / "out")))
    written = {o["name"]: (tmp_path / "out" / o["name"]).read_bytes() for o in result.manifest["outputs"]}
    assert {o["name"]: (o["rows"], o["sha256"]) for o in result.manifest["outputs"]} == {k: (v.count(b"\n"), hashlib.sha256(v).hexdigest()) for k, v in written.items()}
    assert not list((tmp_path / "out").glob("*.part"))
    train = [json.loads(x)["messages"][1]["content"] for x in written["train.jsonl"].decode().splitlines()]
    assert train == sorted(train, key=lambda s: hashlib.sha256(f"0\x1f{s}".encode()).hexdigest()) and len(train) == 240


def test_lines_are_read_in_blocks_and_numbered(spark, tmp_path):
    import hashlib

    texts = {"a.txt": "﻿да ||| 네\r\nнет ||| 아니요\rx\n\nlast", "b.txt": "".join(f"{'ж' * (i % 90)} ||| {i}\r\n" for i in range(3000)), "c.txt": "", "d.md": "one\r\ntwo\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"good ||| x\n\xff\xfe ||| y\n")
    paths = [str(tmp_path / n) for n in [*texts, "bad.txt", "a.txt"]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = readers.read_lines(spark, paths)
        assert read.filter("file = 1").rdd.getNumPartitions() > 8  # one file is several tasks
        got = {}
        for r in read.filter("file <> 4").orderBy("file", "line").collect():
            got.setdefault(r["file"], []).append((r["line"], r["raw"]))
        whole = {r["file"]: r["text"] for r in readers.files(spark, paths).collect()}
        for i in (0, 1, 3, 5):
            assert got[i] == list(enumerate(whole[i].removesuffix("\n").split("\n"), 1))
            assert readers.digest(spark, paths[i]) == hashlib.sha256(whole[i].encode()).hexdigest()
        assert 2 not in got
        bad = readers.read_pairs(spark, paths).filter("file = 4").collect()
        assert [(r["line"], r["problem"]) for r in bad] == [(0, "encoding")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
