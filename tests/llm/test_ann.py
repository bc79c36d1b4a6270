import numpy as np
import pytest

from parquill.llm.ann import VantageTree, nearest


def brute(rows, k, ask):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) and len(v) == 3]
    out = {}
    for q, v in good:
        if q is not None and ask(q) and q not in out:
            found = sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def got(frame, **options):
    out = {}
    for r in sorted(nearest(frame, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


KIND = "vec_id long, embedding array<float>, shard string, rank int"


def test_search_equals_brute_force_with_ties_and_bad_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in draw.integers(-3, 4, 3)]) for i in range(700)] + [(700 + i, [1.0, 2.0, 3.0]) for i in range(200)]
    rows += [(5000, None), (5020, []), (5040, [0.0, 0.0, 0.0]), (5060, [1.0, None, 1.0]), (5080, [1.0, float("nan"), 1.0]), (5100, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (5120, [1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(4)
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert got(frame, query="vec_id % 20 = 0", k=20, shard_vectors=100) == want
    assert got(frame, query="vec_id % 20 = 0", k=20) == want


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.5, 0.5, 0.0])]
    assert got(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND), query="vec_id % 20 = 0") == {0: [(20, 0.5)], 20: [(0, 0.5)]}
    assert got(spark.createDataFrame([(0, [1.0, 0.0, 0.0], "x", 1)], KIND), query="vec_id % 20 = 0") == {}
    assert got(spark.createDataFrame([], KIND), query="vec_id % 20 = 0") == {}
    twice = got(spark.createDataFrame([(0, [1.0, 0.0, 0.0], "x", 1), (20, [1.0, 0.0, 0.0], "x", 1), (20, [2.0, 0.0, 0.0], "x", 1)], KIND), query="vec_id = 0")
    assert twice == {0: [(20, 2.0), (20, 1.0)]}


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.3, 0.9)])
def test_factor_trades_recall(factor, least):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 32))
    vectors = centres[draw.integers(0, 60, 4000)] + 0.2 * draw.normal(size=(4000, 32))
    ids = draw.permutation(4000)
    tree = VantageTree(vectors, ids, leaf=32)
    queries = draw.choice(4000, 200, replace=False)
    found, scores = tree.search(vectors[queries], ids[queries], 10, factor)
    hits = 0
    for row, q in enumerate(queries):
        s = np.where(np.arange(4000) == q, -np.inf, vectors @ vectors[q])
        best = set(ids[np.argsort(-s)[:10]])
        hits += len(best & set(found[row]))
    assert hits / 2000 >= least and (np.diff(scores, axis=1) <= 0).all()
