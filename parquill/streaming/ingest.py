"""Structured Streaming: continuous ingestion of pair lines, and a sink for translated fragments.

Only what needs no whole corpus runs as a stream: parsing, row checks and exact duplicates within a
watermark. Conflicts and splits depend on order and totals, so they stay batch operators.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parquill.functions.text import key, length_problem, payload, strip
from parquill.sources.readers import COMMENT


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value, path, at) of text lines of files as they come; ``at`` is the file's time."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))


def parse_pairs(lines: DataFrame, max_length_ratio: float = 8.0, max_chars: int | None = None) -> DataFrame:
    """Pairs of a stream (or table) of lines, with ``problem`` as the batch reader gives it."""
    used = lines.withColumn("s", strip(F.col("value"))).filter((F.col("s") != "") & ~F.startswith("s", F.lit(COMMENT)))
    sides = F.split("s", r"\|\|\|", -1)
    cut = used.withColumns({"n": F.size(sides), "source": payload(F.get(sides, F.lit(0))), "target": payload(F.get(sides, F.lit(1)))})
    problem = F.when(F.col("n") != 2, "delimiter").when(F.col("source") == "", "left").when(F.col("target") == "", "right").otherwise(length_problem(F.col("source"), F.col("target"), max_length_ratio, max_chars))
    return cut.select("path", "at", "source", "target", key(F.col("source")).alias("source_key"), key(F.col("target")).alias("target_key"), problem.alias("problem"))


def distinct_pairs(pairs: DataFrame, within: str = "1 hour") -> DataFrame:
    """Good pairs, exact repeats dropped while they come within the watermark; state stays bounded."""
    return pairs.filter("problem is null").withWatermark("at", within).dropDuplicatesWithinWatermark(["source_key", "target_key"])


def write_fragments(fragments: DataFrame, folder: str, checkpoint: str, ident: str = "doc_id") -> StreamingQuery:
    """Fragments (id, index, fragment) of a stream appended as Parquet, a micro-batch at a time."""

    def append(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(ident, "index").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return fragments.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_index(line: str, folder: str) -> None:
    """One line at the end of a run index."""
    with (Path(folder) / "index.jsonl").open("a", encoding="utf-8") as out:
        out.write(line + "\n")
