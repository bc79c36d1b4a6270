"""Line dedup by a sharded minimal perfect hash.

1. Every text is cut into lines; a line's key is hashed to 128 bits and kept once a document.
2. Documents of each distinct hash are counted (partial sums first, so a frequent line is no hot key).
3. For each shard of the distinct hashes a minimal perfect hash gives slots of two compact arrays: a
   32-bit fingerprint and the number of documents. Where that number is large enough, a third array has
   the largest document id.
4. Documents probe the arrays, whose counts decide: only (document id, hash) goes to the shards, never a
   line. A shard's arrays are small, so they are copied to several cells and a frequent line's probes are
   dealt over them.
5. What the probes found goes back by document id, and each text drops its lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.llm.arrow import as_text, BLANK, code_points, raw, tidy
from parquill.llm.perfect_hash import PerfectHash, dump, load
from parquill.runtime import checkpoint

#: Keys of one shard's arrays, at most about: half a MB.
SHARD_KEYS = 65_536
#: Cells that hold a copy of each shard's arrays, at least.
LEAST_COPIES = 8


def _keys(text: bytes, least: int) -> Iterator[tuple[int, bytes | None]]:
    """Each line's number and its key's 16-byte hash; None for a line too short to be looked at."""
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(BLANK)
        long_enough = len(key) >= least and (len(key) >= 4 * least or code_points(key) >= least)
        yield i, xxhash.xxh3_128_digest(key) if long_enough else None


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stats_col: str | None = "line_stats", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines gone from ``text_col``; all other columns and all rows stay.

    A line's key has the ASCII blanks at both ends stripped and A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` rows lose their lines everywhere but in the
    largest id that holds them; there all of them stay. ``stats_col`` (None: no such column) is a
    struct of ``n_lines`` (before) and ``n_dropped``; a column of that name in ``docs`` is replaced.

    Null or empty text: one empty line; null stays null unless a line is dropped, and none can be. Rows
    with a null id are not counted and keep all lines. Rows that repeat an id count as documents of
    their own and share the keeping of that id's lines. An empty table gives an empty result.
    """
    hashes = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", T.LongType())])

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, owner, n = [], [], 0
            for doc, text in zip(part.column(0).to_pylist(), raw(part.column(1)), strict=True):
                if own := {k for _, k in _keys(text, min_chars) if k}:
                    found.append(b"".join(own))
                    owner.append((doc, len(own)))
                    n += len(own)
            pairs = np.frombuffer(b"".join(found), np.int64).reshape(n, 2)
            ids = np.repeat(np.array([x for x, _ in owner], np.int64), [k for _, k in owner])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(ids)], names=["h1", "h2", "id"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pairs = checkpoint(texts.filter("id is not null").mapInArrow(tidy(gather), hashes))
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    found = _probe(pairs, counted, min_docs).groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))

    others = [c for c in docs.columns if c not in (text_col, stats_col)]
    side = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    joined = side.join(found, "id", "left").select("row", "text", "drop")
    stats = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("stats", stats)])

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, kept, lines, gone = raw(part.column(1)), [], [], []
            null = part.column(1).is_null().to_pylist()
            for text, drop, was_null in zip(texts, part.column(2).to_pylist(), null, strict=True):
                n, k = text.count(b"\n") + 1, 0
                if drop:
                    bad = {np.array([d["h1"], d["h2"]], np.int64).tobytes() for d in drop}
                    stay = {i for i, key in _keys(text, min_chars) if key not in bad}
                    k = n - len(stay)
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i in stay)
                kept.append(None if was_null else text)
                lines.append(n)
                gone.append(k)
            counts = pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["n_lines", "n_dropped"])
            yield pa.RecordBatch.from_arrays([part.column(0), as_text(kept), counts], names=["row", "text", "stats"])

    done = joined.mapInArrow(tidy(rewrite), out)
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != stats_col]
    return done.select(*columns, *[F.col("stats").alias(c) for c in [stats_col] if c])


def _probe(pairs: DataFrame, counted: DataFrame, min_docs: int) -> DataFrame:
    """Of ``pairs``, those whose key has ``min_docs`` documents and whose id is not the largest that holds it."""
    spark = pairs.sparkSession
    shards = max(1, math.ceil(pairs.count() / SHARD_KEYS))
    copies = max(LEAST_COPIES, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    shard = F.expr(f"cast(pmod(h1, {shards}) as int)")
    index_type = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("arrays", T.BinaryType())])
    kind = np.uint8 if min_docs < 1 << 8 else np.uint32

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def done(k: int) -> pa.RecordBatch:
            high, low, n, top = (np.concatenate(x) for x in zip(*held.pop(k), strict=True))
            index = PerfectHash.build(high, low)
            to = np.empty(len(high), np.int64)
            to[index.slots(high, low)] = np.arange(len(high))
            counts = np.minimum(n[to], np.iinfo(kind).max).astype(kind)
            blob = dump(words=index.words, bits=index.bits, fingerprints=low[to].astype(np.uint32), counts=counts, tops=top[to][counts >= min_docs])
            return pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "arrays": pa.array([blob], pa.binary())})

        for part in parts:  # sorted by shard: one is held at a time
            of = part.column(0).to_numpy()
            columns = [part.column(i).to_numpy() for i in range(1, 5)]
            for k in np.unique(of):
                for other in [x for x in held if x != k]:
                    yield done(other)
                held.setdefault(int(k), []).append([c[of == k] for c in columns])
        for k in list(held):
            yield done(k)

    rows = counted.select(shard.alias("shard"), "h1", "h2", "n", "top")
    index = checkpoint(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(build), index_type))

    copied = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "arrays", *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "id")])
    probes = pairs.select(shard.alias("shard"), F.expr(f"cast(pmod(xxhash64(id), {copies}) as int)").alias("copy"), F.lit(None).cast("binary").alias("arrays"), "h1", "h2", "id")
    cells = copied.unionByName(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("id").isNotNull())

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, arrays = None, None, {}
        for part in parts:
            cell = part.column(0).to_numpy().astype(np.int64) * (1 << 31) + part.column(1).to_numpy()
            blobs = part.column(2)
            start = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)] if len(cell) else []
            for a, b in zip(start, start[1:], strict=False):
                if cell[a] != now:
                    now, index = cell[a], None
                if blobs[a].is_valid:
                    arrays = load(blobs[a].as_py())
                    index, a = PerfectHash(arrays["words"], arrays["bits"]), a + 1
                    enough = arrays["counts"] >= min_docs
                    rank = np.cumsum(enough) - 1  # of a slot among those that have a largest id
                if index is None or a == b:
                    continue
                high, low, ids = (part.column(i).slice(a, b - a).to_numpy() for i in (3, 4, 5))
                slot = index.slots(high, low)
                hit = (slot >= 0) & (arrays["fingerprints"][slot] == low.astype(np.uint32)) & enough[slot]
                hit[hit] = arrays["tops"][rank[slot[hit]]] != ids[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (high, low, ids)], names=["h1", "h2", "id"])

    return cells.mapInArrow(tidy(look), pairs.schema)
