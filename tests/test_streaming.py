import os

from pyspark.sql import functions as F

from parquill.streaming import ingest


def test_pairs_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("# c\nда ||| 네\nда  ||| 네\nнет\n", encoding="utf-8")
    (tmp_path / "in/b.txt").write_text("да ||| 네\nещё ||| 더\n", encoding="utf-8")
    parsed = ingest.parse_pairs(ingest.read_lines(spark, str(tmp_path / "in")))
    query = ingest.distinct_pairs(parsed).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["source"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["да", "ещё"]


def test_fragments_are_kept_by_micro_batch(spark, tmp_path):
    spark.range(6).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("index"), F.lit("x").alias("fragment")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, index long, fragment string").parquet(str(tmp_path / "in"))
    ingest.write_fragments(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    ingest.append_index("{}", str(tmp_path))
    assert os.path.getsize(tmp_path / "index.jsonl") == 3


def test_progress_is_told(spark, tmp_path):
    import time

    from parquill.streaming.progress import ProgressListener

    told = []
    spark.streams.addListener(listener := ProgressListener(told.append))
    try:
        spark.range(5).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while (not told or told[-1].phase != "done") and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0].phase == "start" and told[-1].phase == "done" and told[-1].rows == 5 and told[-1].ok


def test_streamed_breaker_equals_the_batch_operator(spark, tmp_path):
    import random

    from parquill.operators.mapping import breaker
    from parquill.streaming.breaker import stream_breaker

    draw, kind = random.Random(4), "doc_id long, index int, text string, ok boolean, last boolean"
    rows = [(d, i, draw.choice(["x", "x", ""]), draw.random() < 0.5) for d in range(12) for i in range(12)]
    rows = [(d, i, t, ok or not t, i == 11) for d, i, t, ok in rows]
    for part in range(3):  # chunks 0 to 3 of all documents, then 4 to 7, and so on
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        stream_breaker(stream, limit=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["doc_id"], r["index"]): r["aborted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = breaker(spark.createDataFrame(rows, kind), "doc_id", limit=2, empty=F.col("text") == "")
    assert got == {(r["doc_id"], r["index"]): r["aborted"] for r in batch.collect()}


def test_documents_share_groups_and_those_that_ended_leave_no_state(spark, tmp_path):
    from parquill.operators.mapping import breaker
    from parquill.streaming.breaker import BUCKETS, stream_breaker

    kind, n, base = "doc_id long, index int, text string, ok boolean, last boolean", 3 * BUCKETS, 2**53
    both = spark.range(n).crossJoin(spark.range(6).withColumnRenamed("id", "i")).select(F.when(F.col("id") > 0, base + F.col("id")).alias("doc_id"), F.col("i").cast("int").alias("index"), F.when(F.col("i") % 5 == 3, F.lit("")).otherwise(F.lit("x")).alias("text"), (F.hash("id", "i") % 3 == 0).alias("ok"), ((F.col("i") == 5) & (F.col("id") % 2 == 1)).alias("last"))
    held = []
    for part in range(2):
        both.filter(F.col("index") % 6 >= 3 if part else F.col("index") < 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_breaker(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), limit=2)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.recentProgress[0]["stateOperators"][0]["numRowsTotal"])
    assert 0 < max(held) <= BUCKETS + 1  # a row a group, not one a document
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = breaker(both, "doc_id", limit=2, empty=F.col("text") == "").select("doc_id", "index", "ok", "aborted")
    assert got.count() == 6 * n and got.exceptAll(batch).count() == 0 and got.filter("aborted").count() > n
