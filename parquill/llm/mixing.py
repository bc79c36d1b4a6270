"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Block j (from 1) of a source of weight w is released at slot
floor((j-1)/w) and due at ceil(j/w); the scheduler gives each slot to the released block with the
earliest deadline. On one processor that meets all deadlines, so after every slot t each source has had
within one block of w*t.

Weights are whole shares of their sum Q. After Q slots every source has had exactly its share, so the
schedule repeats: only one period of Q slots is computed, or the phase if it is shorter, and each block
finds its slot from its number alone. When a source has no block left, the phase ends and the others go
on by their own shares. The driver computes as many slots as there are blocks at most, and blocks are
so large that these are no more than ``MAX_SLOTS``, unless few sources need fewer slots anyway.

Shares from counts are so many in all that each is within ``SHARE_ERROR`` of its weight, however small.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shares in all when weights are derived from counts, or a multiple of them so that no share is farther from its weight, in parts of it.
SHARES, SHARE_ERROR = 1_000, 0.02
#: Rows of a source that one window partition numbers, about, and such partitions of a source at most.
BUCKET_ROWS, MAX_BUCKETS = 256, 50_000
#: Rows of a block at least, and slots of all phases' periods, which are computed on the driver and broadcast, at most: 8 MB.
BLOCK_ROWS, MAX_SLOTS = 16, 1_000_000
#: Weights are a list on the driver, so sources are few; more than this raises.
MAX_SOURCES = 10_000


def period(shares: Mapping[str, int], left: Mapping[str, int] | None = None) -> list[str]:
    """One period: the source of each slot, by earliest deadline first. It ends early with the slot in which a source gets the last of its ``left`` blocks."""
    if any(v < 1 for v in shares.values()):
        raise ValueError("shares must be at least 1")
    ranked = sorted(shares, key=lambda s: (-shares[s], s))
    share = [shares[s] for s in ranked]
    return [ranked[i] for i in _slots(share, [left[s] if left else n + 1 for s, n in zip(ranked, share, strict=True)])]


def _slots(share: list[int], last: list[int]) -> list[int]:
    """The slots of ``period`` as places in the lists; shares fall, so first deadlines rise and are a heap as they are."""
    total = sum(share)
    done = [0] * len(share)
    waiting: list[tuple[int, int]] = []  # (release, source)
    ready = [(-(-total // n), i) for i, n in enumerate(share)]  # (deadline, source)
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-((done[i] + 1) * -total // share[i]), i))
        _, i = heapq.heappop(ready)
        slots.append(i)
        done[i] += 1
        if done[i] == last[i]:
            break
        if done[i] < share[i]:
            heapq.heappush(waiting, (done[i] * total // share[i], i))
    return slots


def phases(blocks: Mapping[str, int], shares: Mapping[str, int]) -> list[dict]:
    """Phases of the whole schedule: first slot, its period, and each source's blocks before it.

    A phase ends with the slot in which a source gets its last block.
    """
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (-shares[s], s))
    share, left, given = [shares[s] for s in names], [blocks[s] for s in names], [0] * len(names)
    out, start = [], 0
    while names:
        slots = _slots(share, left)
        size = len(slots)
        at: dict[int, array] = {}
        for k, i in enumerate(slots):
            at.setdefault(i, array("q")).append(k)
        # The first source to run out, at its last block's slot, ends the phase.
        length = min((left[i] - 1) // len(x) * size + x[(left[i] - 1) % len(x)] for i, x in at.items()) + 1
        whole, rest = divmod(length, size)
        took = {i: whole * len(x) + bisect_left(x, rest) for i, x in at.items()}
        out.append({"start": start, "length": length, "size": size, "at": {names[i]: x for i, x in at.items()}, "before": {names[i]: given[i] for i in at}, "took": {names[i]: n for i, n in took.items()}})
        start += length
        for i, n in took.items():
            given[i] += n
            left[i] -= n
        if over := {i for i in took if not left[i]}:
            names, share, left, given = ([x for i, x in enumerate(of) if i not in over] for of in (names, share, left, given))
    return out


def share_scale(rows: Mapping[str, int], alpha: float) -> int:
    """The multiple of ``SHARES`` by which all shares are within ``SHARE_ERROR`` of their weights."""
    powers = [n**alpha for n in rows.values()]
    whole = sum(powers)
    scale = 1
    if min(powers) * SHARES < whole:
        scale = math.ceil(whole / (min(powers) * SHARES))
    while any(abs(max(1, round(x)) - x) > SHARE_ERROR * x for x in (SHARES * scale * p / whole for p in powers)):
        scale *= 2
    return scale


def shares_by_count(rows: Mapping[str, int], alpha: float, total: int | None = None) -> dict[str, int]:
    """Shares as rows ** alpha: 1 keeps proportions, 0 makes all sources equal."""
    powers = {s: n**alpha for s, n in rows.items()}
    whole = sum(powers.values())
    total = total or SHARES * share_scale(rows, alpha)
    return {s: max(1, round(total * p / whole)) for s, p in powers.items()}


def rows_of_block(rows: int, sources: int, period_slots: int, most: int = MAX_SLOTS) -> int:
    """The smallest block, of ``BLOCK_ROWS`` at least, with which the schedule takes no more than ``most`` slots and one for each source."""
    if sources * period_slots <= most:  # one period a phase
        return BLOCK_ROWS
    return max(BLOCK_ROWS, -(-rows // most))


def mix_sources(docs: DataFrame, *, shares: Mapping[str, int] | None = None, alpha: float = 0.7, block_rows: int | None = None, id_col: str = "doc_id", source_col: str = "source", prefix: str = "mix_") -> DataFrame:
    """All rows of ``docs`` with their place in the mixture.

    ``shares`` has each source's whole share; sources that it lacks, and all when None, get shares by
    ``shares_by_count(alpha)``. Blocks have ``block_rows`` rows, by default ``rows_of_block``. Added columns: ``mix_phase``, ``mix_block`` (the source's block number),
    ``mix_slot`` (the block's slot, gapless from 0 over all blocks) and ``mix_row`` (the row's number in
    its block); columns of these names in ``docs`` are
    replaced, and names with ``_mix_`` before are for the operator's use. No row is left out or repeated.

    A null source is the source ''. Rows of one source are ordered by a hash of the id, then the id;
    null ids come first, and rows that repeat an id take places next to each other in any order. An
    empty table gives an empty result. Only counts by source and bucket of rows meet in small tasks.
    """
    source, bucket, rank, before, number, key, phased = (f"_{prefix}{x}" for x in ("source", "bucket", "rank", "before", "number", "key", "phases"))
    added = [f"{prefix}{x}" for x in ("phase", "block", "slot", "row")]
    base = docs.drop(*added).withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    counts = {r[0]: r[1] for r in base.groupBy(source).count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; map them to fewer before mixing")
    if not counts:
        return base.drop(source).select("*", *[F.lit(None).cast("long").alias(c) for c in added])
    given = dict(shares or {})
    if any(s not in given for s in counts):  # given shares are of SHARES
        scale = share_scale(counts, alpha)
        given = {s: n for s, n in shares_by_count(counts, alpha, SHARES * scale).items() if s not in given} | {s: n * scale for s, n in given.items()}
    block_rows = block_rows or rows_of_block(sum(counts.values()), len(counts), sum(given[s] for s in counts))
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan = phases(blocks, given)

    buckets = min(MAX_BUCKETS, max(1, -(-max(counts.values()) // BUCKET_ROWS)))
    dealt = base.withColumn(bucket, F.expr(f"pmod(xxhash64(`{id_col}`, 17), {buckets})"))
    sizes = dealt.groupBy(source, bucket).agg(F.count("*").alias(rank))
    ahead = sizes.select(source, bucket, F.coalesce(F.sum(rank).over(Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    order = Window.partitionBy(source, bucket).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col))
    placed = dealt.withColumn(rank, F.row_number().over(order)).join(ahead, [source, bucket])
    placed = placed.withColumn(number, F.col(before) + F.col(rank) - 1).withColumn(added[1], F.expr(f"`{number}` div {block_rows}"))

    spark = docs.sparkSession
    rows = [
        (s, ph["before"][s], ph["before"][s] + ph["took"][s], k, ph["start"], ph["size"], len(ph["at"][s]), ph["at"][s].tolist())
        for k, ph in enumerate(plan)
        for s in ph["at"]
        if ph["took"][s]
    ]
    own = F.broadcast(_schedule(spark, rows).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "phase", "base", "size", "own", "spots"))).alias(phased)).withColumnRenamed("s", key))
    joined = placed.join(own, F.col(source) == F.col(key))
    entry, block = f"_{prefix}entry", f"`{added[1]}`"
    joined = joined.withColumn(entry, F.expr(f"filter(`{phased}`, x -> x.lo <= {block} and {block} < x.hi)[0]"))
    slot = F.expr(f"`{entry}`.base + (({block} - `{entry}`.lo) div `{entry}`.own) * `{entry}`.size + `{entry}`.spots[cast(({block} - `{entry}`.lo) % `{entry}`.own as int)]")
    keep = [F.col(f"`{c}`") for c in base.columns if c != source]
    return joined.select(*keep, F.col(f"{entry}.phase").alias(added[0]), F.col(added[1]), slot.alias(added[2]), F.expr(f"`{number}` % {block_rows}").alias(added[3]))


def _schedule(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The schedule's rows as a table: source, its first and next phase's block, phase, slots."""
    names = ("s", "lo", "hi", "phase", "base", "size", "own", "spots")
    kinds = (pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()))
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}))


def in_order(docs: DataFrame, *, rows_of_part: int = 20_000, **options: object) -> DataFrame:
    """``docs`` in the order of the mixture: each partition holds one range of the schedule's slots, in order, and partitions follow each other.

    Options are those of ``mix_sources``. There are as many partitions as shuffles have, and more where a
    partition would have more than ``rows_of_part`` rows.
    """
    placed = mix_sources(docs, prefix="_mix_", **options)
    rows, last = placed.agg(F.count("*"), F.max("_mix_slot")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_of_part))
    slots = (last or 0) + 1
    ranged = placed.repartitionById(parts, F.expr(f"cast(_mix_slot * {parts} div {slots} as int)"))
    return ranged.sortWithinPartitions("_mix_slot", "_mix_row").select(*docs.columns)
