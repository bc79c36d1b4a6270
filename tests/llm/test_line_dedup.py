import random
from collections import defaultdict

import numpy as np
import pytest

from parquill.llm import line_dedup
from parquill.llm.line_dedup import dedup_lines
from parquill.llm.perfect_hash import PerfectHash

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
KIND = "doc_id long, text string, n_lines long, h1 string, id int"


def brute(rows, least=20, docs=3):
    """(text, lines, dropped) of each row."""
    cut = [[(x, x.strip(" \t\n\x0b\x0c\r").translate(FOLD)) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for (d, _), lines in zip(rows, cut, strict=True):
        for k in {k for _, k in lines if len(k) >= least} if d is not None else ():
            holders[k].append(d)
    gone = lambda d, k: d is not None and len(holders.get(k, ())) >= docs and max(holders[k]) != d
    out = []
    for (d, t), lines in zip(rows, cut, strict=True):
        kept = [x for x, k in lines if not gone(d, k)]
        out.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame([(d, t, 7, "x", 3) for d, t in rows], KIND).repartition(3)
    got = dedup_lines(frame, **options)
    assert got.columns == [*frame.columns, "line_stats"] and {(r["n_lines"], r["h1"], r["id"]) for r in got.collect()} <= {(7, "x", 3)}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2:])
    want = sorted(brute(rows, options.get("min_chars", 20), options.get("min_docs", 3)), key=key)
    assert sorted(((r["doc_id"], r["text"], r["line_stats"]["n_lines"], r["line_stats"]["n_dropped"]) for r in got.collect()), key=key) == want


def test_random_corpora_equal_brute_force(spark):
    draw = random.Random(1)
    pool = ["Shared line of some twenty characters", "\tshared LINE of some twenty characters \r", "short", "", "Ünïcödé line of code poi", "é" * 20, "é" * 19, "another shared line, rather long", "  another Shared Line, rather long"]
    rows = [(i, "\n".join(draw.choice(pool) if draw.random() < 0.6 else f"own line number {i} of a document {draw.random()}" for _ in range(draw.randrange(0, 9)))) for i in range(60)]
    check(spark, rows)


def test_edges(spark):
    line = "a line that is long enough to count"
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (None, line), (None, line), (4, line), (5, line + "\n" + line), (6, line + "\nx"), (7, "x" * 300_000 + "\n" + line), (7, line), (7, line)])
    check(spark, [(-5, line), (-4, line), (-3, line)])
    check(spark, [(1, line)] * 3)
    check(spark, [])


def test_hot_line_is_dealt_over_cells(spark):
    check(spark, [(i, f"the very same line in each document\nown {i}") for i in range(400)])


def test_perfect_hash():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20_000):
        high, low = draw.integers(-(2**63), 2**63 - 1, (2, n))
        slots = PerfectHash.build(high, low).slots(high, low)
        assert sorted(slots) == list(range(n))
    index = PerfectHash.build(np.array([1, 1]), np.array([1, 2]))
    assert set(index.slots(np.array([1, 1, 5]), np.array([1, 2, 9]))[:2]) == {0, 1}
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1]), np.array([1, 1]))


def test_many_shards_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    rows = [(i, f"a line held by all of the documents\nline of tens of documents {i % 10}\nline that only one document has {i}") for i in range(320)]
    check(spark, rows, min_docs=3)
    check(spark, rows, min_docs=33)
    check(spark, rows, min_docs=300)
    check(spark, rows, min_docs=1)
