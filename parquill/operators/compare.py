"""Two scored arms into one verdict: tallies, noise floor, bootstrap; and comparability of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parquill.errors import DatasetError, DecodingMismatchError
from parquill.functions.text import nfc
from parquill.runtime import checkpoint

#: The share of differing outputs below which no delta counts, the least delta told, resamples and their interval.
MIN_FRACTION, MIN_DELTA, RESAMPLES, CONFIDENCE = 0.5, 1.0, 1000, 0.95
IMPROVED, REGRESSED, INDISTINGUISHABLE, UNAVAILABLE = VERDICTS = ("improved", "regressed", "indistinguishable", "unavailable")
CONVENTION, SPREAD, BOOTSTRAP = "convention", "empirical-repeat-spread", "bootstrap-ci"
SAME_NOTE = "The arms wrote nearly the same; whether the adapter did nothing or was never applied cannot be told."
CONFOUNDED_NOTE = "The adapter was fitted to another base, so the delta has more than one cause."


def join_arms(base: DataFrame, adapter: DataFrame, on: str = "line", strict: bool = True) -> DataFrame:
    """Rows of both arms by line: (line, base_output, adapter_output, base_score, adapter_score).

    ``strict`` refuses arms that do not have the same lines.
    """
    a, b = (d.select(F.col(on).alias(f"_{n}"), F.col("output").alias(f"{n}_output"), F.col("score").alias(f"{n}_score")) for n, d in (("base", base), ("adapter", adapter)))
    both = a.join(b, F.col("_base") == F.col("_adapter"), "full_outer")
    if strict and both.filter("_base is null or _adapter is null").limit(1).count():
        raise DatasetError("the arms have different lines")
    return both.withColumn(on, F.coalesce("_base", "_adapter")).drop("_base", "_adapter")


def tally(arms: DataFrame) -> DataFrame:
    """Wins, losses and ties of the adapter, by segment score, and the share of outputs that differ."""
    differ = nfc(F.col("base_output")) != nfc(F.col("adapter_output"))
    up, down = F.col("adapter_score") > F.col("base_score"), F.col("adapter_score") < F.col("base_score")
    return arms.agg(
        F.count("*").alias("n"),
        F.count_if(up).alias("wins"),
        F.count_if(down).alias("losses"),
        F.count_if(~up & ~down).alias("ties"),
        F.coalesce(F.avg(differ.cast("double")), F.lit(0.0)).alias("fraction"),
    )


def spread(repeats: DataFrame, by: str = "arm", score: str = "corpus_score") -> DataFrame:
    """Range of each arm's repeat scores; null below two repeats."""
    return repeats.groupBy(by).agg(F.when(F.count(score) >= 2, F.max(score) - F.min(score)).alias("spread"))


def floors(spreads: DataFrame, bootstrap: Column | float | None = None) -> DataFrame:
    """One row: ``floor``, the largest of its bases (``floor_bases``), from arms' repeat spreads in column ``spread``.

    The convention always counts, the largest spread where an arm had two repeats, the bootstrap where given.
    """
    largest = F.max("spread")
    given = bootstrap if isinstance(bootstrap, Column) else F.lit(bootstrap).cast("double")
    made = spreads.agg(largest.alias("s"), F.max(given).alias("b"))
    values = {CONVENTION: F.lit(MIN_DELTA), SPREAD: F.col("s"), BOOTSTRAP: F.col("b")}
    bases = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return made.select(F.greatest(*values.values()).alias("floor"), bases.alias("floor_bases"))


def draw(seed: int, resample: Column, position: Column, size: Column) -> Column:
    """The index that a resample takes at a position: the first 32 bits of an MD5, modulo the size."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), position.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), size)


def bootstrap_means(arms: DataFrame, seed: int, resamples: int = RESAMPLES, on: str = "line") -> DataFrame:
    """Mean delta of each paired resample: (resample, mean); none below two pairs.

    Deltas are numbered in line order. Each resample's drawn indices are counted first, so the join by
    index gets a row for each resample and index that it drew, and sums are partly taken before a shuffle.
    """
    deltas = arms.select(F.col(on), (F.col("adapter_score") - F.col("base_score")).alias("delta"))
    numbered = checkpoint(_numbered(deltas, on))
    n = numbered.count()
    if n < 2:
        return arms.sparkSession.createDataFrame([], "resample long, mean double")
    drawn = arms.sparkSession.range(resamples * n).select((F.col("id") / n).cast("long").alias("resample"), F.pmod("id", F.lit(n)).alias("position"))
    times = drawn.select("resample", draw(seed, F.col("resample"), F.col("position"), F.lit(n)).alias("index")).groupBy("resample", "index").agg(F.count("*").alias("times"))
    return times.join(numbered, "index").groupBy("resample").agg((F.sum(F.col("times") * F.col("delta")) / n).alias("mean"))


def _numbered(rows: DataFrame, on: str) -> DataFrame:
    """``rows`` with ``index`` from 0 in the order of ``on``: ranges of it are numbered apart and shifted by the rows before."""
    ranged = rows.repartitionByRange(on).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(on))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = ranged.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return placed.select((F.col("_before") + F.col("_own") - 1).alias("index"), "delta")


def bootstrap_floor(arms: DataFrame, delta: Column | float, seed: int, resamples: int = RESAMPLES, on: str = "line") -> DataFrame:
    """One row: the interval of resampled means and the floor, |delta| if it holds 0, else 0; 0 below two pairs."""
    tail = (1 - CONFIDENCE) / 2
    low, high = int(tail * (resamples - 1)), int((1 - tail) * (resamples - 1))
    means = bootstrap_means(arms, seed, resamples, on).agg(F.array_sort(F.collect_list("mean")).alias("m"))
    at = means.select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))
    size = F.abs(delta if isinstance(delta, Column) else F.lit(float(delta)))
    return at.withColumn("floor", F.when((F.col("low") <= 0) & (F.col("high") >= 0), size).otherwise(F.lit(0.0)))


def verdict(delta: Column, fraction: Column, floor: Column, confounded: Column | bool = False) -> Column:
    """The verdict, in order of precedence."""
    doubt = confounded if isinstance(confounded, Column) else F.lit(confounded)
    return (
        F.when(doubt, UNAVAILABLE)
        .when(fraction < MIN_FRACTION, INDISTINGUISHABLE)
        .when(F.abs(delta) <= floor, INDISTINGUISHABLE)
        .when(delta > 0, IMPROVED)
        .otherwise(REGRESSED)
    )


def compare(arms: DataFrame, base_corpus: float, adapter_corpus: float, *, spreads: list[float | None] = (), fingerprints: tuple[str, str] | None = None, confounded: bool = False, bootstrap_seed: int | None = None) -> DataFrame:
    """One row: verdict, delta, floor and its bases, fraction, tallies, note."""
    if fingerprints and fingerprints[0] != fingerprints[1]:
        raise DecodingMismatchError(f"decoded as {fingerprints[0][:12]} and {fingerprints[1][:12]}")
    delta = adapter_corpus - base_corpus
    bases = {CONVENTION: MIN_DELTA}
    if known := [s for s in spreads if s is not None]:
        bases[SPREAD] = max(known)
    if bootstrap_seed is not None:
        bases[BOOTSTRAP] = bootstrap_floor(arms, delta, bootstrap_seed).first()["floor"]
    floor = max(bases.values())
    d, f = F.lit(float(delta)), F.lit(float(floor))
    note = F.when(F.lit(confounded), CONFOUNDED_NOTE).when(F.col("fraction") < MIN_FRACTION, SAME_NOTE)
    made = F.create_map(*[x for k, v in bases.items() for x in (F.lit(k), F.lit(float(v)))])
    return tally(arms).select(verdict(d, F.col("fraction"), f, confounded).alias("verdict"), d.alias("delta"), f.alias("floor"), made.alias("floor_bases"), F.col("fraction").alias("distinguishable_fraction"), "wins", "losses", "ties", note.alias("note"))


#: What two runs must share to be compared.
COMPARABLE = ("test_sha256", "test_limit", "prompt_shape_fingerprint")


def compare_runs(first: DataFrame, second: DataFrame, on: str | None = None) -> DataFrame:
    """Pairs of run records: ``comparable``, ``reasons`` and, only where comparable, ``delta`` of deltas.

    Records have ``run_id``, ``delta`` and the ``COMPARABLE`` columns. ``on`` names a column by which they
    meet; without it ``first`` is one record, which is compared with all of ``second``.
    """
    names = ("run_id", "delta", *COMPARABLE)
    if on is None:
        rows = first.select(*names).limit(2).collect()
        if len(rows) > 1:
            raise ValueError("several first records: name the column that pairs them")
        kinds = {c: first.schema[c].dataType for c in names}
        one = rows[0] if rows else None
        both = second.select(*[F.lit(one[c] if one else None).cast(kinds[c]).alias(f"a_{c}") for c in names], *[F.col(c).alias(f"b_{c}") for c in names])
        both = both if one else both.limit(0)
    else:
        a, b = (d.select(F.col(on).alias(f"{s}_on"), *[F.col(c).alias(f"{s}_{c}") for c in names]) for s, d in (("a", first), ("b", second)))
        both = a.join(b, F.col("a_on").eqNullSafe(F.col("b_on")))
    reasons = F.filter(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in COMPARABLE]), lambda r: r.isNotNull())
    delta = F.when(F.size(reasons) == 0, F.col("b_delta") - F.col("a_delta"))
    return both.select(F.col("a_run_id").alias("first_run"), F.col("b_run_id").alias("second_run"), (F.size(reasons) == 0).alias("comparable"), reasons.alias("reasons"), delta.alias("delta"))
