"""Mapping chunks through a translation function: retries, markers, circuit breaker, reassembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquill.functions import chunker

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])
MAX_FAILURES = 3


def translator(make: Callable[[], Callable[[str], str]], retries: int = 0) -> Callable[[Column], Column]:
    """A column function of ``make()``'s function, which is made once a Python worker and may raise.

    Any ordinary exception fails one text, after ``retries`` more attempts; interrupts and lack of
    memory end the task.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        translate = make()

        def attempt(text: str | None) -> tuple[str | None, bool, str | None]:
            if not text:
                return "", True, None
            for left in range(retries, -1, -1):
                try:
                    return translate(text), True, None
                except MemoryError:
                    raise
                except Exception as error:  # noqa: BLE001
                    if not left:
                        return None, False, f"{type(error).__name__}: {error}"
            raise AssertionError

        for texts in batches:
            yield pd.DataFrame([attempt(t) for t in texts], columns=["text", "ok", "error"])

    return run


def breaker(chunks: DataFrame, ident: str, *, index: str = "index", ok: str = "ok", limit: int = MAX_FAILURES, empty: Column | None = None) -> DataFrame:
    """``chunks`` with ``aborted``, whether ``limit`` failures in a row came before it in its document, and ``tripped``, whether they came up to it.

    Chunks without text are never aborted. A failed chunk's place in its run of failures is its distance
    to the last one that was ok; all windows share one shuffle by document.
    """
    by_doc = Window.partitionBy(ident).orderBy(index)
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(by_doc)
    last_ok = F.coalesce(F.max(F.when(F.col(ok), F.col("_n"))).over(upto), F.lit(0))
    marked = chunks.withColumn("_n", n).withColumn("_run", F.col("_n") - last_ok)
    tripped = F.coalesce(F.max(F.col("_run") >= max(1, limit)).over(before), F.lit(False))
    full = ~empty if empty is not None else F.lit(True)
    now = F.max(F.col("_run") >= max(1, limit)).over(upto)
    return marked.withColumns({"aborted": tripped & full, "tripped": now}).drop("_n", "_run")


def translate_documents(docs: DataFrame, translate: Callable[[Column], Column], *, ident: str, text: str, budget: int, limit: int = MAX_FAILURES) -> DataFrame:
    """Documents translated chunk by chunk: ``text``, ``chunks_total``, ``chunks_failed`` and ``aborted``.

    Chunks are translated in parallel, so those that the breaker aborts may have been tried; their
    results are not used. ``translate_in_order`` spares the attempts.
    """
    cut = chunker.chunk_rows(docs, ident, text, budget).withColumn("r", translate(F.col("text")))
    judged = breaker(cut.withColumn("ok", F.col("r.ok")), ident, limit=limit, empty=F.col("text") == "")
    return _assembled(docs, ident, judged.withColumn("ok", F.col("ok") & ~F.col("aborted")))


def _assembled(docs: DataFrame, ident: str, judged: DataFrame) -> DataFrame:
    said = F.when(F.col("ok"), F.col("r.text")).otherwise(chunker.marker(F.col("index"), F.col("text")))
    done = judged.withColumn("fragment", chunker.render(F.col("lead"), said, F.col("tail")))
    parts = F.array_sort(F.collect_list(F.struct("index", "fragment", "ok")))
    grouped = done.groupBy(ident).agg(parts.alias("p"), F.count("*").alias("n"), F.max("tripped").alias("a"))
    failed = F.transform(F.filter("p", lambda x: ~x["ok"]), lambda x: x["index"])
    out = grouped.select(ident, F.array_join(F.transform("p", lambda x: x["fragment"]), "").alias("text"), F.col("n").alias("chunks_total"), failed.alias("chunks_failed"), F.col("a").alias("aborted"))
    empty = docs.select(ident).join(out.select(ident), ident, "left_anti").select(ident, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("chunks_total"), F.expr("cast(array() as array<int>)").alias("chunks_failed"), F.lit(False).alias("aborted"))
    return out.union(empty)


def translate_in_order(make: Callable[[], Callable[[str], str]], *, budget: int, retries: int = 0, limit: int = MAX_FAILURES) -> Callable[[Column], Column]:
    """A column function that translates whole documents, one chunk after the other, and stops trying when the breaker trips."""

    @F.pandas_udf("struct<text:string,chunks_total:bigint,chunks_failed:array<int>,aborted:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        translate = make()
        for texts in batches:
            rows = []
            for source in texts:
                parts, failed, row, total, stopped = [], [], 0, 0, False
                for c in chunker.chunk(source or "", budget):
                    total += 1
                    said = None if c.text else ""
                    for _ in range(0 if stopped or not c.text else retries + 1):
                        try:
                            said = translate(c.text)
                            break
                        except MemoryError:
                            raise
                        except Exception:  # noqa: BLE001
                            continue
                    if said is None:
                        failed.append(c.index)
                        row += 1
                        stopped = stopped or row >= max(1, limit)
                        said = f"[[UNTRANSLATED chunk={c.index}]]\n{c.text}\n[[/UNTRANSLATED chunk={c.index}]]"
                    else:
                        row = 0
                    parts.append(c.lead + said.strip() + c.tail)
                rows.append(("".join(parts), total, failed, stopped))
            yield pd.DataFrame(rows, columns=["text", "chunks_total", "chunks_failed", "aborted"])

    return run


def fold_tokens(stream: Column) -> tuple[Column, Column]:
    """Text and last finish reason of an array of (text, finish_reason)."""
    return F.array_join(F.transform(stream, lambda t: t["text"]), ""), F.try_element_at(stream, F.lit(-1))["finish_reason"]


def completion_problem(text: Column, finish_reason: Column, delimiters: list[str]) -> Column:
    """``reasoning`` if a delimiter is in the text, else ``truncated`` unless it finished by itself, else null."""
    leaked = F.lit(False)
    for d in delimiters:
        leaked = leaked | F.contains(text, F.lit(d))
    return F.when(leaked, "reasoning").when(~finish_reason.eqNullSafe(F.lit("stop")), "truncated")
