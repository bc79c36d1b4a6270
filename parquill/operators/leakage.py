"""Overlap of a test split with training data, by canonical forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parquill.functions.text import UNIT, canonical

#: Rows of two numbers, and bytes of texts, up to which a counted side is broadcast; items that are searched in all documents.
BROADCAST_ROWS, BROADCAST_BYTES, SHORT_ROWS = 100_000, 16_000_000, 10_000


def overlaps(test: DataFrame, other: DataFrame, *, pair: bool = False) -> DataFrame:
    """Test rows whose source (or source and target) the other side has: ``line`` and the first ``other_line``.

    Both have ``line``, ``source`` and ``target``. The other side is reduced to one row a key first.
    """
    names = ["source", "target"] if pair else ["source"]
    keys = [canonical(F.col(c)).alias(f"_k{i}") for i, c in enumerate(names)]
    named = [f"_k{i}" for i in range(len(names))]
    first = other.select("line", *keys).groupBy(*named).agg(F.min("line").alias("other_line"))
    return test.select("line", *keys).join(first, named).select("line", "other_line")


def overlap_summary(test: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """By other split and kind (source, pair): ``hits``, and the first one's ``line`` and ``other_line``.

    Every side is read once: the other splits' lines by source are reduced to one row a split and pair,
    and met by source in one join.
    """
    keys = [canonical(F.col(c)).alias(f"_k{i}") for i, c in enumerate(("source", "target"))]
    sides = None
    for name, other in others.items():
        one = other.select(F.lit(name).alias("split"), "line", *keys)
        sides = one if sides is None else sides.union(one)
    by_pair = sides.groupBy("split", "_k0", "_k1").agg(F.min("line").alias("other_line"))
    met = test.select("line", *keys).withColumnRenamed("_k1", "_t1").join(by_pair, "_k0")
    same = F.min(F.when(F.col("_k1").eqNullSafe(F.col("_t1")) & F.col("_k1").isNotNull(), F.col("other_line")))
    by_line = met.groupBy("split", "line").agg(F.min("other_line").alias("source"), same.alias("pair"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("other_line")) for k in ("source", "pair")])).alias("k")
    hits = by_line.select("split", "line", kinds).select("split", "line", "k.*").filter("other_line is not null")
    found = hits.groupBy("split", "kind").agg(F.count("*").alias("hits"), F.min(F.struct("line", "other_line")).alias("first"))
    listed = [(name, kind) for name in others for kind in ("source", "pair")]
    spark = test.sparkSession
    asked = spark.createDataFrame(listed, "split string, kind string")
    return asked.join(F.broadcast(found), ["split", "kind"], "left").select("split", "kind", F.coalesce("hits", F.lit(0)).alias("hits"), "first.line", "first.other_line")


def without_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "text") -> DataFrame:
    """``docs`` without rows whose canonical text is one of the benchmark's."""
    items = benchmark.select(canonical(F.col(item)).alias("_k")).distinct()
    return docs.withColumn("_k", canonical(F.col(text))).join(items, "_k", "left_anti").drop("_k")


def containments(docs: DataFrame, benchmark: DataFrame, *, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", anchor_words: int = 4) -> DataFrame:
    """(item, document) where a document's canonical text holds an item's whole.

    An item's first words are its anchor; documents' windows of as many words meet anchors in an
    equi-join, and only those pairs are searched. Items with fewer words, or whose anchor's ends may
    stand inside a word, are met by their inner words, so nothing is missed: an item of under
    ``anchor_words + 2`` words is searched in all documents, and such items must be few.
    """
    items = benchmark.select(F.col(item).alias("item_id"), canonical(F.col(item_text)).alias("item_text")).filter("item_text <> ''")
    words = F.split("item_text", " ")
    # The first and last word may be parts of words; those between them are whole. Anchors meet by a hash: a chance hit is searched in vain.
    long_items = items.filter(F.size(words) >= anchor_words + 2)
    anchors = long_items.select("item_id", F.xxhash64(F.slice(words, 2, anchor_words)).alias("anchor"))
    short = items.filter(F.size(words) < anchor_words + 2).limit(SHORT_ROWS + 1).collect()
    if len(short) > SHORT_ROWS:
        raise ValueError(f"more than {SHORT_ROWS} items of under {anchor_words + 2} words")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    small = lambda side, fits: F.broadcast(side) if fits else side
    texts = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    # Only ids travel with the windows; texts come back, and are made canonical again, for the few documents that hold an anchor.
    cut = texts.select("doc_id", F.split(canonical(F.col("text")), " ").alias("w")).filter(F.size("w") >= anchor_words)
    windows = cut.select("doc_id", F.explode(F.expr(f"array_distinct(transform(sequence(1, size(w) - {anchor_words - 1}), i -> xxhash64(slice(w, i, {anchor_words}))))")).alias("anchor"))
    met = windows.join(small(anchors, size["n"] <= BROADCAST_ROWS), "anchor").select("item_id", F.col("doc_id").alias("_met")).distinct()
    held = texts.join(met, F.col("doc_id") == F.col("_met")).select("doc_id", "item_id", canonical(F.col("text")).alias("doc_text"))
    hits = held.join(small(long_items, size["bytes"] <= BROADCAST_BYTES), "item_id").filter(F.contains("doc_text", "item_text")).select("item_id", "doc_id").distinct()
    if not short:
        return hits
    listed = F.from_json(F.lit(json.dumps([r.asDict() for r in short])), f"array<{items.schema.simpleString()}>")
    rest = texts.select("doc_id", canonical(F.col("text")).alias("doc_text")).select("doc_id", F.explode(F.filter(listed, lambda i: F.contains(F.col("doc_text"), i["item_text"]))).alias("i"))
    return hits.union(rest.select("i.item_id", "doc_id"))


def split_digest(split: DataFrame, line: str = "line", source: str = "source", target: str = "target") -> DataFrame:
    """SHA-256 over a split's canonical pairs in line order, as one row.

    A digest of the whole in order needs the whole in one row, so this is for test splits, which are
    read by people and small.
    """
    row = F.concat(canonical(F.col(source)), F.lit(UNIT), canonical(F.col(target)))
    lines = F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), row.alias("t"))))
    return split.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["t"]), "\n"), 256).alias("digest"), F.count("*").alias("n_lines"))
