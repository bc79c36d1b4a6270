"""Functions over Arrow batches hold few rows as Python objects, whatever a batch holds."""

import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parquill.functions import batches, chrf, text


def most_python_bytes(run, *columns):
    tracemalloc.start()
    try:
        out = run(*columns)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("made", ["_nfc", "_fold", "_canonical"])
def test_whole_texts_become_python_objects_a_few_at_a_time(made):
    values = pa.array([f"É{i} " + "x" * 10_000 for i in range(5_000)])  # 50 MB
    out, most = most_python_bytes(getattr(text, made).func, values)
    assert len(out) == 5_000 and most < 20_000_000


def test_slices_are_few_rows_and_nothing_is_left_out():
    values = pa.array([f"é{i} abab" for i in range(2 * batches.MOST + 5)])
    assert [len(x) for x in batches._few((values, values), chrf.counted, pa.struct([(k, pa.list_(pa.int64())) for k in "mhr"]))] == [batches.MOST, batches.MOST, 5]
    out = chrf._counts.func(values, values)
    assert len(out) == len(values) and out[7].as_py()["m"] == out[7].as_py()["h"] == [6, 5, 4, 3, 2, 1]


def test_results_equal_python_over_slices(spark):
    draw = random.Random(5)
    texts = [None if draw.random() < 0.1 else "".join(draw.choice("aßÉé  \x1f\nx") for _ in range(draw.randrange(12))) for _ in range(2 * batches.MOST + 7)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = rows.select("i", text.canonical(F.col("t")).alias("c"), chrf.counts(F.col("t"), F.reverse("t")).alias("n")).orderBy("i").collect()
    canonical = lambda t: " ".join(unicodedata.normalize("NFC", t).split()).casefold()
    assert [r["c"] for r in got] == [None if t is None else canonical(t) for t in texts]
    assert [r["n"]["h"][0] for r in got] == [len("".join(unicodedata.normalize("NFC", t or "").split())) for t in texts]
