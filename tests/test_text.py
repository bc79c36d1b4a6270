import sys
import unicodedata

from pyspark.sql import functions as F

from parquill.functions import text


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_strip_and_collapse_know_all_white_space(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert len(spaces) == 29
    assert values(spark, [f"{s}a{s}{s}b{s}" for s in spaces], text.collapse) == ["a b"] * 29
    assert values(spark, [f"{s}a{s}{s}b{s}" for s in spaces], text.strip) == [f"a{s}{s}b" for s in spaces]
    assert values(spark, ["​a", "﻿a"], text.strip) == ["​a", "﻿a"]


def test_payload_is_composed_and_keeps_case_and_spaces(spark):
    word = "한글  Текст й"
    assert values(spark, [f" {unicodedata.normalize('NFD', word)} "], text.payload) == [word]
    assert values(spark, [word], text.key) == ["한글 Текст й"]


def test_canonical_folds_case(spark):
    assert values(spark, ["  Straße\tΣΑΣ ", "ABC  d", None], text.canonical) == ["strasse σασ", "abc d", None]


def test_dense_has_no_white_space(spark):
    assert values(spark, [" a b\n c", "é"], text.dense) == ["abc", "é"]


def test_length_problem_takes_the_first_bound(spark):
    rows = spark.createDataFrame([("a" * 240, "ab"), ("a" * 16, "ab"), ("abcdef", "abcdef"), ("", "ab")], "s string, t string")

    def problems(ratio, chars=None):
        return [r[0] for r in rows.select(text.length_problem(F.col("s"), F.col("t"), ratio, chars)).collect()]

    assert problems(8.0) == ["ratio", None, None, None]
    assert problems(0, 5) == ["chars", "chars", "chars", None]
    assert problems(200.0, 5) == ["chars", "chars", "chars", None]


def test_group_hash_is_sha256_of_seed_and_key(spark):
    import hashlib

    assert values(spark, ["ключ"], lambda c: text.group_hash(7, c)) == [hashlib.sha256(b"7\x1f" + "ключ".encode()).hexdigest()]
