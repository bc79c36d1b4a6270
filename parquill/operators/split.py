"""The seeded split: whole groups of a source go to train, valid or test, greedily, in hash order.

The order is global, but its running sums are not taken in one task: groups are cut by the hash's first
digits, sums by those (65,536 at most) are accumulated first, and each bucket adds its own.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parquill.errors import PrepareError
from parquill.functions.text import group_hash
from parquill.runtime import checkpoint

#: Hexadecimal digits of a bucket.
DIGITS = 4
TRAIN, VALID, TEST = "train", "valid", "test"


@dataclass(frozen=True)
class SplitPlan:
    """Rows that each split should get; the last one gets what is left."""

    sizes: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, total: int, valid_fraction: float, test_fraction: float) -> SplitPlan:
        """Cuts [0, total) at the last floor(total * fraction) rows of each asked split; what is before them is train."""
        asked = {name: f for name, f in ((VALID, valid_fraction), (TEST, test_fraction)) if f}
        if not all(0 < f < 1 for f in asked.values()) or sum(asked.values()) >= 1:
            raise PrepareError("fractions must be in [0, 1) and sum to less than 1")
        rows = [math.floor(total * f) for f in asked.values()]
        ends = [*itertools.accumulate([total - sum(rows), *rows])]
        for (name, f), a, b in zip(asked.items(), ends, ends[1:], strict=False):
            if a == b:
                raise PrepareError(f"{name} at {f} of {total} rows is empty; at least {math.ceil(1 / f)} rows are needed")
        return cls(tuple(zip((TRAIN, *asked), (b - a for a, b in itertools.pairwise([0, *ends])), strict=True)))


def running(groups: DataFrame, digest: str, ident: str, size: str) -> DataFrame:
    """``groups`` with ``upto``, the sum of sizes up to each group in (digest, ident) order."""
    bucket = F.substring(digest, 1, DIGITS)
    sums = groups.groupBy(bucket.alias("_bucket")).agg(F.sum(size).alias("_sum"))
    before = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    own = groups.withColumn("_bucket", bucket)
    inside = F.sum(size).over(Window.partitionBy("_bucket").orderBy(digest, ident).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_inside", inside).join(before, "_bucket").withColumn("upto", F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def assign_splits(pairs: DataFrame, *, seed: int = 0, valid_fraction: float = 0.1, test_fraction: float = 0.1, source_key: str = "source_key") -> DataFrame:
    """``pairs`` with ``split``; rows of one source key stay together, whatever the corpus order is.

    A split is full when it has its rows; the group that fills it may overshoot. Order of the result's
    rows inside a split, where it matters, is (``group_hash``, source key, target key, target).
    """
    groups = pairs.groupBy(source_key).agg(F.count("*").alias("_size"))
    hashed = groups.withColumn("group_hash", group_hash(seed, F.coalesce(source_key, F.lit(""))))
    placed = checkpoint(running(hashed, "group_hash", source_key, "_size"))
    total = placed.agg(F.sum("_size")).first()[0] or 0
    plan = SplitPlan.of(total, valid_fraction, test_fraction)
    start = F.col("upto") - F.col("_size")
    split: Column = F.lit(plan.sizes[-1][0])
    bounds, reached = [], 0
    for name, size in plan.sizes[:-1]:
        full = placed.filter(F.col("upto") >= reached + size).agg(F.min("upto")).first()[0]
        reached = total if full is None else full
        bounds.append((name, reached))
    for name, bound in reversed(bounds):
        split = F.when(start < bound, name).otherwise(split)
    own = placed.select(F.col(source_key).alias("_key"), "group_hash", split.alias("split"))
    return pairs.join(own, pairs[source_key].eqNullSafe(own["_key"])).drop("_key")


def split_counts(split: DataFrame, source_key: str = "source_key") -> DataFrame:
    """Rows and distinct sources by split."""
    return split.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct(source_key).alias("n_sources"))


def ratio_and_length_stats(pairs: DataFrame) -> DataFrame:
    """Minimum, exact median and maximum of length ratios and of source lengths."""
    from parquill.functions.text import length_ratio

    ratio, length = length_ratio(F.col("source"), F.col("target")), F.length("source")
    return pairs.agg(
        F.min(ratio).alias("min_ratio"), F.median(ratio).alias("median_ratio"), F.max(ratio).alias("max_ratio"),
        F.min(length).cast("long").alias("min_length"), F.median(length).cast("long").alias("median_length"), F.max(length).cast("long").alias("max_length"),
    )
