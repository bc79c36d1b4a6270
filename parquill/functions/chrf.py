"""chrF: the character n-gram F-score, by segment and pooled over a corpus.

``counts`` is the fast form: an Arrow UDF that gives each pair's matches and totals by order, so a
corpus is one sum with map-side combine. ``relational_counts`` is the same by explode and groupBy.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.functions import batches
from parquill.functions.text import dense

#: Fixed values of the metric.
ORDERS = 6
BETA = 2.0
SCALE = 100.0
COUNTS = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in "mhr"])


def bags(text: str) -> list[Counter[str]]:
    return [Counter(text[i : i + n] for i in range(len(text) - n + 1)) for n in range(1, ORDERS + 1)]


def _packed(text: str | None) -> str:
    """``dense`` of one text; done here, it takes no Python worker of its own."""
    return "".join(unicodedata.normalize("NFC", text or "").split())


def counted(hyp: str | None, ref: str | None) -> dict[str, list[int]]:
    both = [*zip(bags(_packed(hyp)), bags(_packed(ref)), strict=True)]
    return {"m": [sum(min(n, b[g]) for g, n in a.items() if g in b) for a, b in both], "h": [a.total() for a, _ in both], "r": [b.total() for _, b in both]}


_counts = batches.of_two(counted, COUNTS)


def counts(hypothesis: Column, reference: Column) -> Column:
    """Struct of three arrays by order: matches ``m`` and bag sizes ``h`` and ``r``."""
    return _counts(hypothesis, reference)


def score(matches: Column, hyp: Column, ref: Column) -> Column:
    """The F-score, 0 to 100, of arrays of pooled counts; an order without n-grams counts 0."""

    def mean(part: Column, whole: Column) -> Column:
        shares = F.zip_with(part, whole, lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0)))
        return F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.lit(float(ORDERS))

    precision, recall = mean(matches, hyp), mean(matches, ref)
    weight = F.lit(BETA * BETA)
    return F.when((precision == 0) & (recall == 0), F.lit(0.0)).otherwise(F.lit(SCALE) * (1 + weight) * precision * recall / (weight * precision + recall))


def segment_scores(pairs: DataFrame, hypothesis: str, reference: str, alias: str = "score") -> DataFrame:
    """``pairs`` with each row's counts (``chrf_counts``) and score."""
    counted = pairs.withColumn("chrf_counts", counts(F.col(hypothesis), F.col(reference)))
    return counted.withColumn(alias, score(F.col("chrf_counts.m"), F.col("chrf_counts.h"), F.col("chrf_counts.r")))


def pooled(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corpus scores of rows with ``chrf_counts``: counts are summed, then scored."""
    sums = [F.sum(F.col("chrf_counts")[k][i]).alias(f"{k}{i}") for k in "mhr" for i in range(ORDERS)]
    summed = scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), *sums)
    whole = score(*[F.array(*[F.coalesce(f"{k}{i}", F.lit(0)) for i in range(ORDERS)]) for k in "mhr"])
    return summed.select(*(by or []), "n", whole.alias("corpus_score"))


def relational_counts(pairs: DataFrame, ident: str, hypothesis: str, reference: str) -> DataFrame:
    """(id, order, matches, hyp, ref) by DataFrame operators only."""
    sides = pairs.select(ident, dense(F.col(hypothesis)).alias("h"), dense(F.col(reference)).alias("r"))

    def grams(side: str, flag: int) -> DataFrame:
        orders = F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDERS), F.length(side)))).alias("n")
        cut = sides.filter(F.length(side) > 0).select(ident, side, orders)
        starts = cut.select(ident, "n", side, F.explode(F.expr(f"sequence(1, length({side}) - n + 1)")).alias("at"))
        return starts.select(ident, "n", F.expr(f"substring({side}, at, n)").alias("gram"), F.lit(flag).alias("is_hyp"))

    bag = grams("h", 1).union(grams("r", 0)).groupBy(ident, "n", "gram").agg(F.sum("is_hyp").alias("a"), F.sum(1 - F.col("is_hyp")).alias("b"))
    return bag.groupBy(ident, "n").agg(F.sum(F.least("a", "b")).alias("matches"), F.sum("a").alias("hyp"), F.sum("b").alias("ref"))


def parameters() -> dict[str, object]:
    """What travels beside every score."""
    return {"name": "chrF", "implementation": "parquill.functions.chrf", "char_order": ORDERS, "word_order": 0, "beta": BETA, "normalization": "NFC", "whitespace": "stripped-before-ngrams", "scale": "0-100", "corpus_aggregation": "micro"}
