"""Translating document files: planned, read, mapped chunk by chunk, and committed one by one."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parquill.functions.chunker import BUDGET_TOKENS, budget_chars
from parquill.operators.mapping import MAX_FAILURES, translate_in_order
from parquill.sources import readers, sinks


@dataclass(frozen=True)
class Progress:
    """A step of a document: ``start``, ``chunk_done`` for each chunk, ``done``; ``ok`` as far as it has come."""

    phase: str
    file_index: int
    file_total: int
    source_name: str
    chunks_done: int
    chunks_total: int
    ok: bool


def translate_files(spark: SparkSession, sources: Sequence[str], folder: str, make: Callable[[], Callable[[str], str]], *, force: bool = False, encoding: str = "utf-8-sig", budget_tokens: int = BUDGET_TOKENS, retries: int = 0, limit: int = MAX_FAILURES, progress: Callable[[Progress], None] | None = None) -> dict[str, tuple[int, ...]]:
    """Writes each file's translation into the folder; returns each source's failed chunks.

    All destinations are checked before anything is read, and all sources before anything is translated.
    """
    planned = sinks.plan_batch(sources, folder, force=force)
    docs = readers.read_documents(spark, [str(s) for s, _ in planned], encoding)
    run = translate_in_order(make, budget=budget_chars(budget_tokens), retries=retries, limit=limit)
    done = docs.repartition(max(1, len(planned)), "file").withColumn("r", run(F.col("text"))).select("file", "r.*")
    failed = {}
    for row in done.toLocalIterator():
        source, to = planned[row["file"]]
        with sinks.PartFile(to) as out:
            out.write(row["text"])
        failed[str(source)] = tuple(row["chunks_failed"])
        if row["aborted"]:
            print(f"{source}: given up after {limit} failures in a row", file=sys.stderr)
        if progress:  # chunks are told when their document comes back from its task
            step = lambda phase, k: progress(Progress(phase, row["file"], len(planned), str(source), k, row["chunks_total"], not any(i < k for i in row["chunks_failed"])))  # noqa: B023, E731
            step("start", 0)
            for k in range(1, row["chunks_total"] + 1):
                step("chunk_done", k)
            step("done", row["chunks_total"])
    return failed
