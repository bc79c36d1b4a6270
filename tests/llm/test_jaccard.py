import random
import re

import numpy as np
import pytest

from parquill.llm import jaccard
from parquill.llm.components import components
from parquill.llm.jaccard import Parts, Tree, Union, link_components, near_duplicates, possible, walk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
KIND = "doc_id long, text string, n int, keys string, a int"


def sets(text, width):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    of = [(d, sets(t, width)) for d, t in rows if d is not None]
    for i, (d, s) in enumerate(of):
        for e, t in of[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return sorted([(d, len(sets(t, width)), d if d is None else root(d)) for d, t in rows], key=repr)


def corpus(seed, n=150):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 3, 8, 9, 10, 11, 30, 80, 200]))) for _ in range(n // 3)]
    while len(texts) < n:
        t = draw.choice(texts).split(" ")
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            k = draw.randrange(len(t))
            t[k : k + draw.choice([0, 1])] = [draw.choice(words)]
        texts.append(" ".join(t).upper() if draw.random() < 0.2 else " ".join(t))
    return list(enumerate(texts))


def got(spark, rows, width, percent):
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], KIND).repartition(3)
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_components(frame, width=width, percent=percent).collect()], key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = corpus(percent)
    assert got(spark, rows, width, percent) == brute(rows, width, percent)


def test_large_groups_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MAP_BLOCK", 16)
    monkeypatch.setattr(jaccard, "MANY_KEYS", 50)
    draw = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(90):  # a chain of slowly changing texts, so most are far from the smallest
        base[draw.randrange(60)] = f"c{i}"
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    assert got(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (None, "one"), (8, "É"), (9, "é"), (10, "x " * 20_000)]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert got(spark, [], 3, 90) == []
    several = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h"), (3, "i j k l"), (4, "i j k l")]
    assert {c for _, _, c in got(spark, several, 3, 90)} == {1}


def test_one_of_each_group_stays(spark):
    rows = corpus(3)
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in [*rows, (None, "w1 w2"), (900, None), (901, "")]], KIND)
    kept = near_duplicates(frame)
    want = {d for d, _, c in brute(rows, 5, 80) if d == c} | {None, 900, 901}
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_trees_find_all_links(percent):
    draw = np.random.default_rng(percent)
    own = []
    for i in range(140):
        if i % 3 == 0 or not own:
            own.append(np.unique(draw.integers(0, 2**63, draw.integers(1, 60)).astype(np.uint64)))
        else:
            keep = own[draw.integers(0, len(own))]
            keep = keep[draw.random(len(keep)) < 0.9]
            own.append(np.unique(np.append(keep, draw.integers(0, 2**63, 2).astype(np.uint64))))
    ids = np.arange(len(own))
    similar = {(a, b) for a in ids for b in ids[:a] if 100 * (n := len(np.intersect1d(own[a], own[b]))) >= percent * (len(own[a]) + len(own[b]) - n)}

    def groups(links):
        union = Union()
        for a, b in links:
            union.join(int(a), int(b))
        return [union.root(int(i)) for i in ids]

    tree = Tree.of_sets(ids, own)
    assert groups(walk(tree, tree, percent, Union())) == groups(similar)
    halves = [Tree.of_sets(ids[:70], own[:70], 256), Tree.of_sets(ids[70:], own[70:], 256)]
    found = [*walk(halves[0], halves[0], percent, Union()), *walk(halves[1], halves[1], percent, Union()), *walk(*halves, percent, Union())]
    assert groups(found) == groups(similar)
    marks = possible(*halves, percent, Union())
    assert all(marks[0][b] and marks[1][a - 70] for a, b in similar if b < 70 <= a)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)]
    got_ = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got_ == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [34, 50, 80, 90, 95, 100])
def test_all_links_between_different_sets_share_a_key(percent):
    draw = np.random.default_rng(percent)
    parts, seen = Parts(percent), 0
    for _ in range(1500):
        size = int(draw.choice([draw.integers(1, 12), draw.integers(12, 100), draw.integers(100, 600)]))
        x = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        change = draw.integers(0, int(1.2 * size * (1 - percent / 100)) + 1)
        gone = draw.integers(0, change + 1)
        y = np.unique(np.concatenate([draw.permutation(x)[gone:], draw.integers(0, 2**63, change - gone).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both < max(len(x), len(y)) and 100 * both >= percent * (len(x) + len(y) - both):
            seen += 1
            assert {*parts.keys(x).tolist()} & {*parts.keys(y).tolist()}
    assert seen > 200 or percent == 100


def test_a_shared_passage_ties_few_texts(spark):
    draw = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, passage + " " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(80))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "id long, text string")
    assert jaccard._common_keys(frame, 3, 90).count() < len(rows)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in [*rows, (3000, rows[7][1] + " end")]], KIND)
    found = link_components(frame, width=3, percent=90).filter("component_id <> doc_id").collect()
    assert [(r["doc_id"], r["component_id"]) for r in found] == [(3000, 7)]


def test_a_large_cluster_with_strays(spark):
    """Near copies of one text, of which many are too far from the smallest id, and some far from all."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6])):
            t[draw.randrange(120)] = f"n{draw.randrange(40)}"
        rows.append((i, " ".join(t)))
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)
