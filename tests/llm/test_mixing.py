from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parquill.llm.mixing import SHARE_ERROR, in_order, mix_sources, period, phases, rows_of_block, shares_by_count


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 12), min_size=1))
def test_each_source_is_always_within_one_block(shares):
    slots, total, done = period(shares), sum(shares.values()), Counter()
    for t, s in enumerate(slots, 1):
        done[s] += 1
        assert all(abs(done[x] * total - w * t) < total for x, w in shares.items())
    assert done == Counter(shares)


def simulate(blocks, shares):
    """The schedule slot by slot, with the plain rule and no period."""
    left, out, start = {s: n for s, n in blocks.items() if n}, [], 0
    while left:
        now = period({s: shares[s] for s in left})
        i = 0
        while True:
            s = now[i % len(now)]
            out.append(s)
            left[s] -= 1
            i += 1
            if not left[s]:
                del left[s]
                break
        start = len(out)
    assert start == len(out)
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(0, 30), st.integers(1, 9)), min_size=1))
def test_phases_equal_a_simulation(given_):
    blocks, shares = {s: n for s, (n, _) in given_.items()}, {s: w for s, (_, w) in given_.items()}
    want, got = simulate(blocks, shares), {}
    for ph in phases(blocks, shares):
        for s, spots in ph["at"].items():
            for b in range(ph["before"][s], ph["before"][s] + ph["took"][s]):
                k = b - ph["before"][s]
                got[ph["start"] + k // len(spots) * ph["size"] + spots[k % len(spots)]] = s
    assert [got[i] for i in range(len(got))] == want


def test_rows_meet_the_schedule(spark):
    rows = [(i, s) for i, s in enumerate("a" * 300 + "b" * 90 + "c" * 7)] + [(None, "a"), (5, None), (5, None)]
    frame = spark.createDataFrame([(d, s, "keep", 1) for d, s in rows], "doc_id long, source string, mix_slot string, s int").repartition(3)
    shares = {"a": 3, "b": 2, "c": 1, "": 1}
    got = mix_sources(frame, shares=shares, block_rows=4).collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot"], set()).add(r["source"] or "")
        assert 0 <= r["mix_row"] < 4
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    blocks = {"a": 76, "b": 23, "c": 2, "": 1}
    assert [next(iter(slots[i])) for i in range(len(slots))] == simulate(blocks, shares)
    assert max(Counter((r["mix_slot"], r["mix_row"]) for r in got).values()) == 1


def test_long_tails_keep_their_weights():
    rows = {"large": 10_000_000} | {f"s{i:04}": 10_000 for i in range(2000)}
    for counts in (rows, {"large": 10_000_000} | {f"s{i:04}": 5_000 + 7 * i for i in range(2000)}):
        shares, powers = shares_by_count(counts, 0.7), {s: n**0.7 for s, n in counts.items()}
        total, whole = sum(shares.values()), sum(powers.values())
        assert all(abs(shares[s] / total / (p / whole) - 1) <= 2 * SHARE_ERROR for s, p in powers.items())
    shares = shares_by_count(rows, 0.7)
    blocks = {s: -(-n // 1600) for s, n in rows.items()}
    plan = phases(blocks, shares)
    assert {s: sum(ph["took"].get(s, 0) for ph in plan) for s in blocks} == blocks
    first = plan[0]
    assert abs(first["took"]["large"] / first["length"] - 0.059) < 0.002
    assert sum(ph["length"] for ph in plan) == sum(blocks.values()) and sum(ph["size"] for ph in plan) <= sum(blocks.values())


def test_edges(spark):
    empty = mix_sources(spark.createDataFrame([], "doc_id long, source string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "mix_phase", "mix_block", "mix_slot", "mix_row"]
    one = mix_sources(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, source string")).collect()
    assert sorted((r["mix_slot"], r["mix_row"]) for r in one) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        period({"a": 0})
    assert shares_by_count({"a": 10, "b": 10}, 0.5) == {"a": 500, "b": 500} and shares_by_count({"a": 10**9, "b": 1}, 1)["b"] == 1


def test_the_order_of_files_is_the_schedule(spark, tmp_path):
    rows = [(i, s) for i, s in enumerate("a" * 900 + "b" * 200 + "c" * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    in_order(frame, rows_of_part=100).write.parquet(str(tmp_path / "mixed"))
    slot = {r["doc_id"]: (r["mix_slot"], r["mix_row"]) for r in mix_sources(frame).collect()}
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    got = [slot[r["doc_id"]] for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert len(files) == 12 and got == sorted(slot.values())


def test_blocks_grow_where_the_schedule_would_not_fit_the_driver():
    assert rows_of_block(10**12, 20, 1000) == 16 and rows_of_block(10**10, 10_000, 10**7, 10**6) == 10_000


def test_equal_ids_in_many_sources_take_all_places(spark):
    frame = spark.createDataFrame([(7, s) for s in "aaab" * 40], "doc_id long, source string")
    got = mix_sources(frame, block_rows=4).collect()
    assert len({(r["mix_slot"], r["mix_row"]) for r in got}) == 160
