import random
import re
from collections import Counter

import numpy as np
import pytest

from parquill.llm import quality_rules as quality_rules_module
from parquill.llm.quality_rules import CLASSES, COMMON_WORDS, base_counts, class_histogram, core, divergence, limits, quality_rules, references

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if again[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force():
    draw = random.Random(2)
    texts = ["", " \n", "a b c a b c", "a a a a", "a a a", "é|É x\n\n#*$%&|<>\n", "x\n x\nx\nx "] + [" ".join(draw.choice(["a", "b", "ç", "d\n", "\t", "$"]) for _ in range(draw.randrange(40))) for _ in range(300)]
    for t in texts:
        assert base_counts(t.encode())[:5] == brute(t), t


def corpus():
    draw = random.Random(3)
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: draw.choice(common) if draw.random() < 0.5 else "".join(draw.choice("etaoinshr") for _ in range(draw.randrange(3, 9)))
    clean = [" ".join(word() for _ in range(draw.randrange(60, 400))).capitalize() + "." for _ in range(200)]
    junk = [" ".join(word() + "***" for _ in range(150)), " ".join(word().upper() + "!!" for _ in range(150)), " | ".join("".join(draw.choice("qzxjkv") for _ in range(9)) for _ in range(150))]
    return clean, junk


KIND = "doc_id long, text string, lang string, kept int, n_words string"


def test_junk_goes_and_clean_texts_stay(spark):
    clean, junk = corpus()
    rows = [(i, t, "en", 1, "x") for i, t in enumerate([*clean, *junk])]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert all(got[i]["kept"] for i in range(len(clean))) and not any(got[len(clean) + i]["kept"] for i in range(len(junk)))
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(rows[i][1]) for i, r in got.items())


def test_references_count_all_documents(spark):
    clean, _ = corpus()
    texts = spark.createDataFrame([("en" if i % 3 else "xx", t) for i, t in enumerate(clean)], "lang string, text string").repartition(5)
    known = references(texts)
    for lang in ("en", "xx"):
        own = [t for i, t in enumerate(clean) if ("en" if i % 3 else "xx") == lang]
        words = Counter(core(w.encode()) for t in own for w in t.split())
        histogram, places, counts = known[lang]
        assert counts.sum() == words.total() and all(words[w] == counts[i] for w, i in places.items())
        assert set(places) == {w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS] if n * 1000 > words.total()}
        assert histogram.sum() == sum(len(w) for t in own for w in t.split())


def test_rare_languages_take_no_word_from_large_ones(spark):
    draw = random.Random(4)
    common = [f"common{i}" for i in range(70)]
    big = [" ".join(draw.choice(common) if draw.random() < 0.4 else f"w{draw.randrange(10**6)}" for _ in range(500)) for _ in range(60)]
    rare = [(f"r{i % 12}", " ".join(f"rare{i}x{k}" for k in range(250)) + " allthe" * 250) for i in range(120)]
    rows = [("en", t) for t in big] + rare
    known = references(spark.createDataFrame(rows, "lang string, text string").repartition(16), 5)
    assert len(known) == 6
    for lang in known:
        words = Counter(w for x, t in rows if not lang or x == lang for w in t.split())
        want = sorted(((-n, w) for w, n in words.items() if n * 1000 > words.total()))[:COMMON_WORDS]
        _, places, counts = known[lang]
        assert [*places] == [w for _, w in want] and counts[:-1].tolist() == [-n for n, _ in want] and counts.sum() == words.total()
    assert known[""][0].sum() == sum(len(w) for _, t in rows for w in t.split())


@pytest.mark.parametrize("languages", [190, 300])
def test_partitions_change_nothing(spark, languages):
    draw = random.Random(languages)
    common = [f"common{i}" for i in range(20)]
    rows = [("en", " ".join(draw.choice(common) if draw.random() < 0.5 else f"w{draw.randrange(10**5)}" for _ in range(60))) for _ in range(600)]
    rows += [(f"l{i % languages}", " ".join(f"x{draw.randrange(10**5)}" for _ in range(30))) for i in range(1900)]
    frame = spark.createDataFrame([(i, t, x, 1, "x") for i, (x, t) in enumerate(rows)], KIND)
    found = [references(frame.select("lang", "text").repartition(n)) for n in (1, 200)]
    assert {*common} <= {*found[0]["en"][1]} and len(found[0]) == languages + 2
    for lang, (classes, places, counts) in found[0].items():
        other = found[1][lang]
        assert places == other[1] and (classes == other[0]).all() and (counts == other[2]).all()


def test_distances_and_kept_equal_brute_force(spark):
    clean, junk = corpus()
    rows = [(i, t, "en" if i % 2 else "fr", 1, "x") for i, t in enumerate([*clean, *junk])]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, KIND).repartition(3)).collect()}

    def distance(p, q):
        a, b = sum(p.values()), sum(q.values())
        js = 0.0
        for k in {*p, *q}:
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            for z in (x, y):
                js += z / 2 * np.log2(2 * z / (x + y)) if z else 0.0
        return max(0.0, js) ** 0.5

    for lang in ("en", "fr"):
        own = [(i, t) for i, t, x, *_ in rows if x == lang]
        classes, words = Counter(), Counter()
        for _, t in own:
            classes.update(quality_rules_module.class_of(c) for c in t if not c.isspace())
            words.update(core(w.encode()) for w in t.split())
        common = {w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS] if n * 1000 > words.total()}
        of = lambda c: Counter({w: n for w, n in c.items() if w in common}) + Counter({"": sum(n for w, n in c.items() if w not in common)})  # noqa: B023, E731
        for i, t in own:
            a = distance(Counter(quality_rules_module.class_of(c) for c in t if not c.isspace()), classes)
            b = distance(of(Counter(core(w.encode()) for w in t.split())), of(words))
            r, n = got[i], len(t.split())
            most = limits(n, quality_rules_module.MAX_CLASS_DISTANCE, quality_rules_module.MAX_WORD_DISTANCE)
            assert r["class_distance"] == pytest.approx(a, abs=1e-6) and r["word_distance"] == pytest.approx(b, abs=1e-6)
            assert r["kept"] == (not r["base_failed"] and not (n >= 50 and (a > most[0] or b > most[1])))


def test_edges(spark):
    rows = [(1, None, "en", 1, "x"), (2, "", None, 1, "x"), (None, "a " * 60, None, 1, "x"), (3, "w" * 100_000, "en", 1, "x"), (3, "w" * 100_000, "en", 1, "x"), (4, " ".join(f"word{i}" for i in range(60)), "", 1, "x")]
    got = quality_rules(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 6 and all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] != 4)
    assert quality_rules(spark.createDataFrame([], KIND)).count() == 0


def test_classes_and_divergence():
    assert class_histogram("Abc 12 (é).\n§x ***\tÉ".encode()).tolist() == [4, 2, 2, 1, 2, 4, 0][: len(CLASSES)]
    assert class_histogram(b"").sum() == 0 and class_histogram(b"a" * 1000)[0] == 1000
    assert divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1) and divergence(np.array([2.0, 2]), np.array([5.0, 5])) == 0 == divergence(np.zeros(2), np.ones(2))
    assert limits(10**9, 0.2, 0.3) == pytest.approx((0.2, 0.3), abs=1e-4) and limits(50, 0.2, 0.3)[1] > 0.45
