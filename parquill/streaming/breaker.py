"""The circuit breaker over a stream of chunk results: state is two numbers for each document in flight."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parquill.operators.mapping import MAX_FAILURES

#: Groups that documents are dealt to by a hash of their id. A group is one call of Python, which costs
#: milliseconds whatever it holds; a micro-batch of a billion chunks has a quarter million in each.
BUCKETS = 4096


def stream_breaker(results: DataFrame, *, limit: int = MAX_FAILURES) -> DataFrame:
    """A stream of (doc_id long, index int, text string, ok boolean, last boolean) with ``aborted``, as the batch operator has it.

    A document's chunks come in order over micro-batches; inside one they are sorted. Its state goes
    with its ``last`` chunk, so only documents in flight are held. Documents are dealt to ``BUCKETS``
    groups, whose state has those of their documents; of texts only whether they are empty is sent.
    """

    def judge(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {d: (n, s) for d, n, s in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(parts, ignore_index=True).sort_values(["doc_id", "index"], kind="stable")
        aborted, ended, now, failures, stopped = [], set(), object(), 0, False
        ids = [None if pd.isna(d) else int(d) for d in rows["doc_id"].tolist()]
        for doc, full, ok, last in zip(ids, rows["full"].tolist(), rows["ok"].tolist(), rows["last"].tolist(), strict=True):
            if doc != now:
                now, (failures, stopped) = doc, held.get(doc, (0, False))
            aborted.append(bool(stopped and full))
            failures = 0 if ok and not aborted[-1] else failures + 1
            stopped = stopped or failures >= max(1, limit)
            held[doc] = failures, stopped
            if last:
                ended.add(doc)
        for doc in ended:
            del held[doc]
        if held:
            state.update(([*held], [n for n, _ in held.values()], [s for _, s in held.values()]))
        elif state.exists:
            state.remove()
        yield rows.assign(aborted=aborted)[["doc_id", "index", "ok", "aborted"]]

    # Documents without an id have a group of their own: beside a null, pandas makes ids floats.
    bucket = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).otherwise(-1)
    used = results.select(F.col("doc_id").cast("long"), F.col("index").cast("int"), F.coalesce(F.col("text") != "", F.lit(False)).alias("full"), "ok", "last")
    kind = "docs array<bigint>, failures array<int>, stopped array<boolean>"
    return used.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(judge, "doc_id long, index int, ok boolean, aborted boolean", kind, "append", GroupStateTimeout.NoTimeout)
