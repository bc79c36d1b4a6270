"""Duplicates and conflicting translations, in corpus order.

Two pairs are duplicates when both keys are equal; a pair conflicts when an earlier one has its source
key with another target key. The loop over rows in order has an exact form by aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_duplicates(pairs: DataFrame, order: Sequence[str], *, allow_conflicts: bool = False, source_key: str = "source_key", target_key: str = "target_key") -> DataFrame:
    """``pairs`` with ``status`` and ``of``, the row (a struct of ``order``) that it repeats or clashes with.

    Statuses: ``keep``, ``duplicate`` (dropped), ``conflict`` (kept, with ``allow_conflicts``) and
    ``problem`` (a conflict that is not allowed; such a row is not remembered, so its repeats are
    problems too).

    Rows need a place of their own in ``order``. What a row repeats is the smallest row of its pair and
    of its source: aggregates, whose partial minima go before the shuffle, and equi-joins, which Spark
    may split. So a source that holds a third of the corpus is no single task, as it were in a window.
    """
    place = F.struct(*order)
    by_pair = pairs.groupBy(source_key, target_key).agg(F.min(place).alias("_same"))
    by_source = by_pair.groupBy(F.col(source_key).alias("_source")).agg(F.min("_same").alias("_first"), F.min_by(target_key, "_same").alias("_first_target"))
    pair_keys = by_pair.select(F.col(source_key).alias("_s"), F.col(target_key).alias("_t"), "_same")
    marked = pairs.join(pair_keys, F.col(source_key).eqNullSafe(F.col("_s")) & F.col(target_key).eqNullSafe(F.col("_t")))
    marked = marked.join(by_source, F.col(source_key).eqNullSafe(F.col("_source")))
    again, clash = place > F.col("_same"), F.col(target_key) != F.col("_first_target")
    if allow_conflicts:
        status = F.when(again, "duplicate").when(clash, "conflict").otherwise("keep")
        of = F.when(again, F.col("_same")).when(clash, F.col("_first"))
    else:
        status = F.when(clash, "problem").when(again, "duplicate").otherwise("keep")
        of = F.when(clash, F.col("_first")).when(again, F.col("_same"))
    return marked.withColumns({"status": status, "of": of}).drop("_s", "_t", "_source", "_same", "_first_target", "_first")


def conflicted_sources(pairs: DataFrame, source_key: str = "source_key", target_key: str = "target_key") -> DataFrame:
    """Source keys with several targets: rows, distinct targets. Partial sums go before the shuffle."""
    by_pair = pairs.groupBy(source_key, target_key).agg(F.count("*").alias("n"))
    return by_pair.groupBy(source_key).agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_targets")).filter(F.col("n_targets") > 1)
