"""Queries over files, records, runs, chunks and streams that are made from the fixture tables, and their SQL."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parquill import adapters, training
from parquill.errors import AdapterMismatchError, AdapterProvenanceError, DestinationError, SplitTooSmallError
from parquill.functions import chrf, chunker
from parquill.operators import compare, leakage, mapping, records
from parquill.plans import evaluate, prepare, validate
from parquill.plans.queries import _KEY, _LINES, _PAIRS, _lines, _pairs
from parquill.runtime import shared_folder, table
from parquill.sources import readers, sinks
from parquill.streaming import breaker as streamed
from parquill.streaming import ingest

SHAPE = records.PromptShape()
MAX_CHARS = 100


def _folder(spark: SparkSession) -> Path:
    """A new folder that driver and executors share, for queries over files."""
    path = Path(shared_folder(spark).removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return path


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[\r\n]+", " ").alias("t"))


def _pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the bytes of a pair file with lines of all kinds; some have a byte-order mark, CRLF or a byte that is no UTF-8."""
    a, b, case = F.substring("t", 1, 60), F.substring("t", 61, 80), (F.col("conv_id") * 31 + F.col("turn")) % 9
    lit = F.lit
    line = (
        F.when(case == 0, F.concat(lit("# "), a)).when(case == 1, lit("   ")).when(case == 2, a).when(case == 3, F.concat(a, lit("|||"), b, lit("|||"), a))
        .when(case == 4, F.concat(lit(" ||| "), b)).when(case == 5, F.concat(a, lit(" |||  "))).when(case == 6, F.concat(a, lit("||||"), b)).otherwise(F.concat(a, lit(" ||| "), b))
    )
    end = F.when(F.col("conv_id") % 3 == 0, "\r\n").otherwise("\n")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    files = _short(spark, sf_dir).groupBy("conv_id").agg(ordered.alias("l"))
    text = F.concat(F.when(F.col("conv_id") % 5 == 0, "﻿").otherwise(""), F.array_join("l", "\x01"), lit("\x01"))
    content = F.encode(F.replace(text, lit("\x01"), end), "utf-8")
    content = F.when(F.col("conv_id") % 7 == 0, F.concat(content, F.unhex(lit("FF")))).otherwise(content)
    return files.select(F.col("conv_id").alias("file"), F.concat(lit("pairs/"), F.col("conv_id").cast("string"), lit(".txt")).alias("path"), *readers.decoded_utf8(content))


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pair files as pairs, with the first problem of each."""
    pairs = readers.pairs_of(_pair_files(spark, sf_dir), max_chars=MAX_CHARS)
    good = F.col("problem").isNull()
    return pairs.select("file", "path", F.col("line").cast("long").alias("line"), F.when(good, F.col("source_key")).alias("source_key"), F.when(good, F.col("target_key")).alias("target_key"), "problem")


def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair file's lines, good pairs and the digest of its text."""
    whole = _pair_files(spark, sf_dir)
    read = readers.lines(whole).groupBy("file").agg(F.count("*").alias("lines_read"))
    good = readers.pairs_of(whole, max_chars=MAX_CHARS).groupBy("file").agg(F.count_if(F.col("problem").isNull()).alias("pairs"))
    told = whole.select("file", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return told.join(read, "file", "left").join(good, "file", "left").select("file", F.coalesce("lines_read", F.lit(0)).alias("lines_read"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "sha256")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.substring("text", 1, 12).alias("source"), F.col("lang").alias("target"))


def leak_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document with the first other one whose beginning is the same."""
    sides = _sides(spark, sf_dir)
    return leakage.overlaps(sides.filter("line % 4 = 0"), sides.filter("line % 4 <> 0"))


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of a test split with two others by source and by pair."""
    sides = _sides(spark, sf_dir)
    return leakage.overlap_summary(sides.filter("line % 4 = 0"), {"train": sides.filter("line % 4 in (1, 2)"), "valid": sides.filter("line % 4 = 3")})


def arm_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms' outputs and scores by line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text")
    arms = [docs.select("line", F.substring("text", a, b).alias("output"), F.expr(f"cast(length(text) % {b} as double)").alias("score")) for a, b in ((1, 40), (5, 40))]
    joined = compare.join_arms(arms[0], arms[1].withColumn("score", F.col("score") + 1))
    return joined.select("line", *[F.md5(f"{n}_output").alias(f"{n}_md5") for n in ("base", "adapter")], "base_score", "adapter_score")


def _spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang <> 'en' or source = 'src0'")
    return compare.spread(docs.groupBy(F.col("lang").alias("arm"), "source").agg(F.avg("n_chars").alias("corpus_score")))


def repeat_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each arm's repeats; languages are arms and sources repeats."""
    return _spreads(spark, sf_dir).select("arm", F.round("spread", 6).alias("spread"))


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor and its bases, with and without a bootstrap's."""
    spreads = _spreads(spark, sf_dir)
    out = None
    for name, bootstrap in (("without", None), ("with", 1e6)):
        bases = F.array_join(F.transform(F.array_sort(F.map_entries("floor_bases")), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 3).cast("decimal(20,3)").cast("string"))), ",")
        one = compare.floors(spreads, bootstrap).select(F.lit(name).alias("bootstrap"), F.round("floor", 6).alias("floor"), bases.alias("bases"))
        out = one if out is None else out.union(one)
    return out


def schema_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSONL files: of one schema, of two, and with a broken line."""
    chat = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    completions, text = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("role").alias("completion"))), F.to_json(F.struct("text"))
    case = F.col("conv_id") % 4
    line = F.when(case == 0, chat).when(case == 1, completions).when((case == 3) & (F.col("turn") == 1), F.lit("{broken")).when((case == 2) & (F.col("turn") < 2), completions).otherwise(text)
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("line"), line.alias("raw"))
    schema, problem = records.classify(F.col("raw"))
    found = records.uniformity(rows.select("conv_id", "line", schema.alias("schema"), problem.alias("problem")), ["conv_id"])
    return found.withColumn("error_line", F.col("error_line").cast("long"))


def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which most are bent in one way, and what is said of them."""
    pairs = _pairs(spark, sf_dir)
    whole = records.build_record(F.col("source"), F.col("target"), SHAPE)
    case = (F.col("conv_id") + F.col("turn")) % 6
    turned = lambda i, role: F.transform(whole, lambda m, k: F.when(k == i, F.struct(m["content"].alias("content"), F.lit(role).alias("role"))).otherwise(m))
    other = F.transform(whole, lambda m, k: F.when(k == 0, F.struct(F.concat(m["content"], F.lit("!")).alias("content"), m["role"].alias("role"))).otherwise(m))
    bent = F.when(case == 0, whole).when(case == 1, F.slice(whole, 1, 2)).when(case == 2, other).when(case == 3, turned(1, "assistant")).when(case == 4, turned(2, "user"))
    read = records.messages_of(records.render_record(F.col("bent")))
    source, _ = records.parse_record(read, SHAPE)
    bad = records.record_problem(read, SHAPE)
    return pairs.withColumn("bent", bent).select("conv_id", "turn", F.when(bad.isNull(), source).alias("source"), F.when(F.col("bent").isNull(), "no messages").otherwise(bad).alias("problem"))


def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the splits that preparation wrote, each checked before training."""
    return _prepared(spark, sf_dir)[1]


def prepared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair files prepared into split files: each one's rows and digest, as the manifest has them."""
    return _prepared(spark, sf_dir)[0]


def prepared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of that preparation counts."""
    return _prepared(spark, sf_dir)[2]


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    folder = _folder(spark)
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    pairs = _pairs(spark, sf_dir).filter("source <> '' and target <> '' and not contains(source, '|||') and not contains(target, '|||') and not startswith(source, '#')")
    for k in range(3):
        lines = pairs.filter(F.col("conv_id") % 3 == k).orderBy("conv_id", "turn").select(F.concat(flat("source"), F.lit(" ||| "), flat("target")).alias("l"))
        sinks.write_file(lines, folder / f"{k}.txt")
    config = prepare.PrepareConfig((str(folder),), str(folder / "out"), 0, 0.1, 0.2, 0.0, None, True)
    manifest = json.loads((Path(prepare.prepare_splits(spark, config).output_dir) / sinks.MANIFEST).read_text(encoding="utf-8"))
    outputs = spark.createDataFrame([(o["name"], o["rows"], o["sha256"]) for o in manifest["outputs"]], "name string, n_rows long, sha256 string")
    rows = spark.createDataFrame([*validate.validate_split_dir(spark, config.output_dir).rows.items()], "name string, n_rows long")
    counts = spark.createDataFrame([*manifest["counts"].items()], "name string, n long")
    return outputs, rows, counts


def _as_prose(text: Column) -> Column:
    """A text with initials, abbreviations, quotations and runs of stops put in."""
    for old, new in _PROSE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_PROSE = ((", ", " ул. "), (" de ", " B. "), (" the ", " x. "), (" le ", " end!» "), (" of ", " wait... "), (" and ", " (so.) "))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into sentences: a chunk of the least budget that holds each, so no two are packed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _as_prose(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("text"))
    return docs.withColumn("s", chunker.sentence_lists(F.coalesce("text", F.lit("")))).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\x01")).alias("md5"))


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.trim("text"), F.lit("\n"), F.lit("\n \n")).alias("text"))


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at blank lines only."""
    return chunker.chunk_rows(_spaced(spark, sf_dir), "doc_id", "text", 10_000_000).select("doc_id", F.col("index").cast("long").alias("index"), F.md5("text").alias("md5"), F.length("tail").cast("long").alias("gap"))


def hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blanks, so words longer than the budget, cut into slices."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text"))
    return chunker.chunk_rows(docs, "doc_id", "text", 64).select("doc_id", F.col("index").cast("long").alias("index"), F.md5("text").alias("md5"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, and words of longer ones, packed next to next into chunks of 300 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _as_prose(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("text"))
    return chunker.chunk_rows(docs, "doc_id", "text", 300).select("doc_id", F.col("index").cast("long").alias("index"), F.md5("text").alias("md5"))


def _bracket() -> Callable[[str], str]:
    """A translation that puts a text into brackets, and fails for a quarter of all texts."""
    import hashlib

    def run(text: str) -> str:
        if hashlib.md5(text.encode()).hexdigest()[0] < "4":
            raise ValueError("no translation")
        return f"<{text}>"

    return run


def _flow(done: DataFrame) -> DataFrame:
    return done.select("doc_id", F.col("chunks_total").cast("long").alias("chunks"), F.array_join("chunks_failed", ",").alias("failed"), "aborted", F.md5("text").alias("md5"))


def document_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents translated chunk by chunk in parallel, with marks for what failed and the breaker."""
    return _flow(mapping.translate_documents(_spaced(spark, sf_dir), mapping.translator(_bracket, 1), ident="doc_id", text="text", budget=10_000_000))


def document_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one chunk after the other."""
    run = mapping.translate_in_order(_bracket, budget=10_000_000, retries=1)
    return _flow(_spaced(spark, sf_dir).select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.*"))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of each source, written, indexed and read back."""
    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    rows = []
    for r in docs.filter("source is not null").collect():  # a source is a run here: tens
        decoding = {"settings": {"max_tokens": r["most"], "repeats": 2}, "fingerprint": records.digest_of({"repeats": 2, "max_tokens": r["most"]})}
        identity = {"source": r["source"], "n": r["n"]}
        now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
        arms = {a: {"corpus_chrf": float(r["n"])} for a in ("base", "adapter")}
        record = {
            "schema_version": 1, "run_id": evaluate.run_id(identity, now), "created_at": f"{now:%Y-%m-%dT%H:%M:%SZ}",
            "test_set": {"path": r["source"], "sha256": "s", "n_lines": r["n"], "n_scored": r["n"], "limit": None, "subset": False},
            "prompt_shape_fingerprint": SHAPE.fingerprint(), "decoding": decoding, "arms": arms, "metric": chrf.parameters(), "scores": {}, "comparison": {"verdict": compare.IMPROVED, "delta": 1.5}, "confounded": False,
        }
        back = readers.read_run(spark, str(evaluate.write_run(record, str(folder))))
        rows.append((back["test_set"]["path"], back["run_id"], back["decoding"]["fingerprint"], records.canonical_json(evaluate.index_line(back))))
    index = (folder / sinks.INDEX).read_text(encoding="utf-8").splitlines()
    if sorted(index) != sorted(r[3] for r in rows):
        raise ValueError("the index has other lines than the records")
    return spark.createDataFrame(rows, "source string, run_id string, decoding string, index_line string")


def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of an adapter's origin: it has none, its base or prompt is another, or it may be applied."""
    folder, rows = _folder(spark), []
    for r in table(spark, sf_dir, "documents").select("source", "lang").distinct().orderBy("source", "lang").collect():
        at = folder / f"{r['source']}-{r['lang']}"
        at.mkdir()
        if r["lang"] != "de":
            adapters.write_provenance(at, adapters.Provenance(f"model-{r['lang']}", r["source"], trainer_version="0.1"))
        warned: list[str] = []
        try:
            known = adapters.check_adapter(at, model="model-en", fingerprint="src0", allow_mismatch=r["lang"] == "fr", warn=warned.append)
            said = "absent" if known is None else "warned" if warned else "good"
        except AdapterMismatchError as error:
            said = "base" if "base model" in str(error) else "prompt"
        except AdapterProvenanceError:
            said = "unusable"
        rows.append((r["source"], r["lang"], said))
    return spark.createDataFrame(rows, "source string, lang string, said string")


@contextmanager
def _environment(**values: str | None):  # noqa: ANN202
    before = {k: os.environ.get(k) for k in values}
    try:
        for k, v in values.items():
            os.environ.pop(k, None)
            if v is not None:
                os.environ[k] = v
        yield
    finally:
        for k, v in before.items():
            os.environ.pop(k, None)
            if v is not None:
                os.environ[k] = v


def config_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that is meant: the argument, else the environment, else the default; blank is absent."""
    rows = []
    for r in table(spark, sf_dir, "documents").select("source", "lang").distinct().collect():
        given = {"en": r["source"], "fr": "  ", "de": None}.get(r["lang"])
        with _environment(**{adapters.MODEL_VARIABLE: None if r["source"] == "src1" else f" env-{r['source']} "}):
            rows.append((r["source"], r["lang"], adapters.resolve_model(given)))
    return spark.createDataFrame(rows, "source string, lang string, model string")


def training_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trainer's arguments of a configuration, in order."""
    config = training.TrainingConfig("data", "m", iterations=5, learning_rate=0.5, mask_prompt=True)
    argv = training.build_argv(config, Path("/to"))[1:]
    return spark.createDataFrame([*enumerate(argv)], "pos long, arg string")


def batch_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's splits have enough rows for a batch."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    rows = []
    for r in counts.filter("source is not null").collect():
        report = validate.SplitReport("d", {"train.jsonl": r["a"], "valid.jsonl": r["b"], "test.jsonl": 0}, ())
        for batch in (None, 22):
            try:
                said = f"{len(training.preflight(report, batch).notices)} notices"
            except SplitTooSmallError:
                said = "too small"
            rows.append((r["source"], batch, said))
    return spark.createDataFrame(rows, "source string, batch long, said string")


def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where translations of files go; of two that would be one, the second is refused."""
    folder = _folder(spark)
    names = [r["name"] for r in table(spark, sf_dir, "documents").select(F.concat_ws(".", "lang", "source", F.lit("txt")).alias("name")).distinct().orderBy("name").collect()]
    rows = [(n, sinks.output_path(n, folder).name, "planned") for n in names]
    for name in names:
        try:
            sinks.plan_batch([f"a/{name}", f"b/{name}"], folder)
        except DestinationError:
            rows.append((name, sinks.output_path(name, folder).name, "collides"))
    return spark.createDataFrame(rows, "name string, output string, said string")


def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets, metric parameters and fingerprints."""
    rows = [(f"budget {n}", str(chunker.budget_chars(n))) for n in (1, 512, 1024)]
    rows += [("metric", records.canonical_json({k: v for k, v in chrf.parameters().items() if k != "implementation"}))]
    rows += [("prompt", SHAPE.fingerprint()), ("decoding", records.digest_of(evaluate.EvaluationConfig().decoding()))]
    return spark.createDataFrame(rows, "name string, value string")


def probe_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe set through a function of one sentence, in order."""
    said = readers.run_probes(str.upper)
    return readers.probes(spark).select(F.col("pos").cast("long").alias("pos"), "text", F.get(F.lit(list(said)), F.col("pos")).alias("said"))


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows of a split by line, which is the feature."""
    return evaluate.limited(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "n_chars"), 100)


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pairs ingested as a stream, exact repeats dropped."""
    folder = _folder(spark)
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    lines = _pairs(spark, sf_dir).select(F.concat(F.substring(flat("source"), 1, 3), F.lit(" ||| "), F.substring(flat("target"), 1, 2)).alias("value"))
    lines.coalesce(2).write.text(str(folder / "in"))
    parsed = ingest.parse_pairs(ingest.read_lines(spark, str(folder / "in")))
    query = ingest.distinct_pairs(parsed).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("source_key string, target_key string").parquet(str(folder / "out"))


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker over a stream of chunk results."""
    folder = _folder(spark)
    rows = _lines(spark, sf_dir).withColumnRenamed("index", "i").withColumn("index", F.col("i"))
    last = F.col("index") == F.max("index").over(Window.partitionBy("doc_id"))
    rows.select("doc_id", "index", "text", "ok", last.alias("last")).write.parquet(str(folder / "in"))
    kind = "doc_id long, index int, text string, ok boolean, last boolean"
    out = streamed.stream_breaker(spark.readStream.schema(kind).parquet(str(folder / "in")))
    out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pair_lines, pair_files, leak_source, isolation, arm_join, repeat_spread, noise_floor, schema_of_files, record_problems, training_files, prepared_splits, prepared_counts,
        sentence_split, paragraph_chunks, hard_split, chunk_pack, document_flow, document_in_order, run_records, provenance_checks, config_choice, training_command, batch_preflight,
        output_plan, constants, probe_run, first_rows, stream_pairs, stream_breaker,
    )
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FOLD = r"replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss')"
_FLAT_HEAD = r"substring(regexp_replace({}, '\s+', ' ', 'g'), 1, {})"
_FILE_LINES = rf"""
    short as (select conv_id, turn, regexp_replace(text, '[\r\n]+', ' ', 'g') as t, (conv_id * 31 + turn) % 9 as c from conversations),
    raws as (
        select conv_id, row_number() over (partition by conv_id order by turn) as line, case c when 0 then '# ' || substring(t, 1, 60) when 1 then '   ' when 2 then substring(t, 1, 60)
            when 3 then substring(t, 1, 60) || '|||' || substring(t, 61, 80) || '|||' || substring(t, 1, 60) when 4 then ' ||| ' || substring(t, 61, 80) when 5 then substring(t, 1, 60) || ' |||  '
            when 6 then substring(t, 1, 60) || '||||' || substring(t, 61, 80) else substring(t, 1, 60) || ' ||| ' || substring(t, 61, 80) end as raw
        from short),
    used as (select conv_id, line, {_STRIP.format("raw")} as s from raws where conv_id % 7 <> 0),
    cut as (select conv_id, line, string_split(s, '|||') as sides from used where s <> '' and not starts_with(s, '#')),
    sided as (select conv_id, line, len(sides) as k, {_STRIP.format("sides[1]")} as source, {_STRIP.format("coalesce(sides[2], '')")} as target from cut),
    judged as (
        select *, case when k <> 2 then 'delimiter' when source = '' then 'left' when target = '' then 'right'
            when greatest(length(source), length(target)) > 8.0::double * greatest(1, least(length(source), length(target))) then 'ratio'
            when greatest(length(source), length(target)) > {MAX_CHARS} then 'chars' end as problem from sided)"""
_JSON = f"""'{{"messages":[{{"role":"system","content":"{records.INSTRUCTION}"}},{{"role":"user","content":' || cast(to_json(source) as varchar) || '}},{{"role":"assistant","content":' || cast(to_json(target) as varchar) || '}}]}}'"""
_PREPARED = rf"""{_PAIRS},
    flat as (
        select conv_id % 3 as file, conv_id, turn, regexp_replace(source, '\s+', ' ', 'g') as source, regexp_replace(target, '\s+', ' ', 'g') as target from pairs
        where source <> '' and target <> '' and not contains(source, '|||') and not contains(target, '|||') and not starts_with(source, '#')),
    numbered as (select *, row_number() over (partition by source, target order by file, conv_id, turn) as rn from flat),
    kept as (select * from numbered where rn = 1),
    groups as (select source as sk, count(*) as size, sha256('0' || chr(31) || source) as h from kept group by source),
    placed as (select *, cast(sum(size) over (order by h, sk) as bigint) as upto from groups),
    total as (select cast(sum(size) as bigint) as n from groups),
    one as (select min(upto) as b1 from placed, total where upto >= n - cast(floor(n * 0.1::double) as bigint) - cast(floor(n * 0.2::double) as bigint)),
    two as (select min(upto) as b2 from placed, total, one where upto >= b1 + cast(floor(n * 0.1::double) as bigint)),
    assigned as (select p.sk, p.h, case when upto - size < b1 then 'train' when upto - size < b2 then 'valid' else 'test' end as split from placed p, one, two),
    written as (
        select split || '.jsonl' as name, count(*) as n_rows, sha256(string_agg({_JSON}, chr(10) order by h, sk, target) || chr(10)) as sha256
        from kept join assigned on source = sk group by split)"""
_CLOSE = "»\"''”’)\\]"
_ABBREVIATED = ", ".join(f"'{a}'" for a in sorted(chunker.ABBREVIATIONS))


def _prose_sql(text: str) -> str:
    for old, new in _PROSE:
        text = f"replace({text}, '{old}', '{new}')"
    return text


_SENTENCES = rf"""
    prose as (select doc_id, {_prose_sql("regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')".replace(chr(92) * 2, chr(92)))} as t from documents),
    parts as (select doc_id, string_split(regexp_replace(t, '([.!?…]+[{_CLOSE}]*)(\s+)', '\1\2' || chr(1), 'g'), chr(1)) as p from prose where t <> ''),
    rows_ as (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as piece from parts),
    known as (
        select *, regexp_extract(piece, '([.!?…]+)[{_CLOSE}]*\s*$', 1) as run, regexp_extract(regexp_replace(piece, '[.!?…]+[{_CLOSE}]*\s*$', ''), '[^\s.!?…]*$') as stem,
            left(lead(piece) over (partition by doc_id order by i), 1) as next_sign from rows_ where piece <> ''),
    ended as (
        select *, case when run <> '.' then 1 when length(stem) = 1 and stem = upper(stem) and stem <> lower(stem) then 0
            when (length(stem) = 1 and stem = lower(stem) and stem <> upper(stem)) or lower(stem) || '.' in ({_ABBREVIATED})
                then case when next_sign = upper(next_sign) and next_sign <> lower(next_sign) then 1 else 0 end else 1 end as ends from known),
    placed_ as (select *, coalesce(sum(ends) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as g from ended),
    sentences as (select doc_id, g, string_agg(piece, '' order by i) as s from placed_ group by doc_id, g)"""
_PARAGRAPHS = r"""
    spaced as (select doc_id, replace(trim(text, ' '), chr(10), chr(10) || ' ' || chr(10)) as whole from documents),
    bodies as (select doc_id, whole, regexp_replace(whole, '^\s+|\s+$', '', 'g') as body from spaced where whole <> ''),
    listed as (select doc_id, whole, body, string_split_regex(body, '\s*\n\s*\n\s*') as p, regexp_extract_all(body, '\s*\n\s*\n\s*') as gaps from bodies),
    paragraphs as (
        select doc_id, unnest(range(0, len(p))) as index, unnest(p) as text, unnest(list_concat(gaps, [''])) as gap, len(p) as n,
            regexp_extract(whole, '^\s*') as lead, case when body = '' then whole else regexp_extract(whole, '\s*$') end as rest from listed)"""
_FLOW = f"""with {_PARAGRAPHS},
    chunks as (select *, text = '' or substring(md5(text), 1, 1) >= '4' as ok, row_number() over (partition by doc_id order by index) as k from paragraphs),
    runs as (select *, k - coalesce(max(case when ok then k end) over (partition by doc_id order by index rows unbounded preceding), 0) as run from chunks),
    judged as (
        select *, max(case when run >= 3 then 1 else 0 end) over (partition by doc_id order by index rows unbounded preceding) = 1 as tripped,
            coalesce(max(case when run >= 3 then 1 else 0 end) over (partition by doc_id order by index rows between unbounded preceding and 1 preceding), 0) = 1 and text <> '' as late from runs),
    said as (
        select doc_id, index, tripped, not ok or late as failed, case when index = 0 and text <> '' then lead else '' end
            || case when text = '' then '' when ok and not late then '<' || text || '>' else '[[UNTRANSLATED chunk=' || index::varchar || ']]' || chr(10) || text || chr(10) || '[[/UNTRANSLATED chunk=' || index::varchar || ']]' end
            || gap || case when index = n - 1 then rest else '' end as fragment from judged),
    flows as (
        select doc_id, count(*) as chunks, coalesce(string_agg(case when failed then index::varchar end, ',' order by index), '') as failed, bool_or(tripped) as aborted, md5(string_agg(fragment, '' order by index)) as md5
        from said group by doc_id)
    select doc_id, coalesce(chunks, 0) as chunks, coalesce(failed, '') as failed, coalesce(aborted, false) as aborted, coalesce(md5, md5('')) as md5 from documents left join flows using (doc_id)"""
_SPREAD = """
    repeats as (select lang as arm, source, avg(n_chars) as score from documents where lang <> 'en' or source = 'src0' group by lang, source),
    spreads as (select arm, case when count(score) >= 2 then max(score) - min(score) end as spread from repeats group by arm)"""

ORACLE_SQL: dict[str, str] = {
    "pair_lines": f"""with {_FILE_LINES}
        select conv_id as file, 'pairs/' || conv_id::varchar || '.txt' as path, line, case when problem is null then {_KEY.format("source")} end as source_key, case when problem is null then {_KEY.format("target")} end as target_key, problem from judged
        union all select distinct conv_id, 'pairs/' || conv_id::varchar || '.txt', 0, null, null, 'encoding' from raws where conv_id % 7 = 0""",
    "pair_files": f"""with {_FILE_LINES}, good as (select conv_id, count(*) filter (where problem is null) as pairs from judged group by conv_id)
        select r.conv_id as file, case when r.conv_id % 7 = 0 then 0 else count(*) end as lines_read, coalesce(any_value(g.pairs), 0) as pairs,
            case when r.conv_id % 7 <> 0 then sha256(string_agg(raw, chr(10) order by line) || chr(10)) end as sha256
        from raws r left join good g on r.conv_id = g.conv_id group by r.conv_id""",
    "leak_source": f"""with d as (select doc_id, {_FOLD.format("substring(text, 1, 12)")} as t from documents)
        select a.doc_id as line, min(b.doc_id) as other_line from d a join d b on a.t = b.t where a.doc_id % 4 = 0 and b.doc_id % 4 <> 0 group by a.doc_id""",
    "isolation": f"""with d as (select doc_id, {_FOLD.format("substring(text, 1, 12)")} as s, {_FOLD.format("lang")} as t from documents),
        o as (select *, case when doc_id % 4 = 3 then 'valid' else 'train' end as split from d where doc_id % 4 <> 0),
        hits as (
            select split, 'source' as kind, a.doc_id as line, min(o.doc_id) as other from d a join o on a.s = o.s where a.doc_id % 4 = 0 group by split, a.doc_id
            union all
            select split, 'pair', a.doc_id, min(o.doc_id) from d a join o on a.s = o.s and a.t = o.t where a.doc_id % 4 = 0 group by split, a.doc_id),
        asked(split, kind) as (values ('train', 'source'), ('train', 'pair'), ('valid', 'source'), ('valid', 'pair'))
        select split, kind, count(line) as hits, min(line) as line, arg_min(other, line) as other_line from asked left join hits using (split, kind) group by split, kind""",
    "arm_join": """select doc_id as line, md5(substring(text, 1, 40)) as base_md5, md5(substring(text, 5, 40)) as adapter_md5,
        cast(length(text) % 40 as double) as base_score, cast(length(text) % 40 as double) + 1 as adapter_score from documents""",
    "repeat_spread": f"with {_SPREAD} select arm, round(spread, 6) as spread from spreads",
    "noise_floor": f"""with {_SPREAD}, largest as (select max(spread) as s from spreads)
        select 'without' as bootstrap, round(greatest(1.0::double, coalesce(s, 0)), 6) as floor, 'convention=1.000' || coalesce(',empirical-repeat-spread=' || cast(cast(round(s, 3) as decimal(20,3)) as varchar), '') as bases from largest
        union all
        select 'with', round(greatest(1000000.0::double, coalesce(s, 0)), 6), 'bootstrap-ci=1000000.000,convention=1.000' || coalesce(',empirical-repeat-spread=' || cast(cast(round(s, 3) as decimal(20,3)) as varchar), '') from largest""",
    "schema_of_files": """with n as (select conv_id, count(*) as n, max(turn) as last, min(turn) as first from conversations group by conv_id)
        select conv_id, n as n_rows, case conv_id % 4 when 0 then 'chat' when 1 then 'completions' when 2 then 'completions' else 'text' end as schema,
            case when conv_id % 4 = 2 and last >= 2 then 'mixed' when conv_id % 4 = 3 and last >= 1 then 'not JSON' end as error,
            cast(case when conv_id % 4 = 2 and last >= 2 then 3 when conv_id % 4 = 3 and last >= 1 then 2 end as bigint) as error_line,
            case when conv_id % 4 = 2 and last >= 2 then 'text' end as other_schema from n""",
    "record_problems": f"""with {_PAIRS} select conv_id, turn, case when (conv_id + turn) % 6 = 0 then source end as source,
        case (conv_id + turn) % 6 when 1 then 'message count' when 2 then 'message 0' when 3 then 'carrier role' when 4 then 'answer role' when 5 then 'no messages' end as problem from pairs""",
    "training_files": f"with {_PREPARED} select name, n_rows from written",
    "prepared_splits": f"with {_PREPARED} select name, n_rows, sha256 from written",
    "prepared_counts": f"""with {_PREPARED}
        select 'pairs_read' as name, count(*) as n from flat union all select 'duplicates_dropped', count(*) from numbered where rn > 1
        union all select 'unique_sources', count(*) from groups union all select replace(name, '.jsonl', ''), n_rows from written""",
    "sentence_split": f"""with {_SENTENCES}, counted as (select doc_id, count(*) as n, md5(string_agg(s, chr(1) order by g)) as md5 from sentences group by doc_id)
        select doc_id, coalesce(n, 0) as n, coalesce(md5, md5('')) as md5 from documents left join counted using (doc_id)""",
    "paragraph_chunks": f"""with {_PARAGRAPHS} select doc_id, index, md5(text) as md5, length(gap) + case when index = n - 1 then length(rest) else 0 end as gap from paragraphs""",
    "hard_split": r"""with dense as (select doc_id, regexp_replace(text, '\s+', '', 'g') as t from documents),
        cut as (select doc_id, t, unnest(range(0, cast(ceil(length(t) / 64.0) as bigint))) as index from dense)
        select doc_id, index, md5(substring(t, index * 64 + 1, 64)) as md5 from cut""",
    "chunk_pack": rf"""with recursive {_SENTENCES},
        cut as (select doc_id, g, case when length(rtrim(s)) <= 300 then [s] else regexp_extract_all(s, '\S{{1,300}}\s*') end as u from sentences),
        loose as (select doc_id, g, unnest(range(0, len(u))) as j, unnest(u) as unit from cut),
        units as (select doc_id, unit, row_number() over (partition by doc_id order by g, j) as k from loose),
        packed as (
            select doc_id, k, 0 as grp, length(unit) as size from units where k = 1
            union all
            select u.doc_id, u.k, case when p.size + length(rtrim(u.unit)) <= 300 then p.grp else p.grp + 1 end,
                case when p.size + length(rtrim(u.unit)) <= 300 then p.size + length(u.unit) else length(u.unit) end
            from packed p join units u on u.doc_id = p.doc_id and u.k = p.k + 1)
        select doc_id, cast(grp as bigint) as index, md5(rtrim(string_agg(unit, '' order by k))) as md5 from packed join units using (doc_id, k) group by doc_id, grp""",
    "document_flow": _FLOW,
    "document_in_order": _FLOW,
    "run_records": f"""with d as (select source, count(*) as n, max(n_chars) as most from documents where source is not null group by source),
        named as (select *, sha256('{{"max_tokens":' || most::varchar || ',"repeats":2}}') as decoding, '20260102T030405Z-' || left(sha256('{{"n":' || n::varchar || ',"source":"' || source || '"}}'), 12) as run_id from d)
        select source, run_id, decoding, '{{"confounded":false,"created_at":"2026-01-02T03:04:05Z","decoding_fingerprint":"' || decoding || '","delta":1.5,"limit":null,"n":' || n::varchar
            || ',"prompt_shape_fingerprint":"{SHAPE.fingerprint()}","run_id":"' || run_id || '","scores":{{"adapter":' || n::varchar || '.0,"base":' || n::varchar || '.0}},"test_set_sha256":"s","verdict":"improved"}}' as index_line from named""",
    "provenance_checks": """select distinct source, lang, case when lang = 'de' then 'absent' when lang = 'fr' then 'warned' when lang <> 'en' then 'base' when source <> 'src0' then 'prompt' else 'good' end as said from documents""",
    "config_choice": f"""select distinct source, lang, case when lang = 'en' then source when source <> 'src1' then 'env-' || source else '{adapters.DEFAULT_MODEL}' end as model from documents""",
    "training_command": """select unnest(range(0, 15)) as pos, unnest(['-m', 'mlx_lm', 'lora', '--train', '--data', 'data', '--model', 'm', '--adapter-path', '/to', '--iters', '5', '--learning-rate', '0.5', '--mask-prompt']) as arg""",
    "batch_preflight": """with c as (select source, count(*) filter (where doc_id % 2 = 0) as a, count(*) filter (where doc_id % 2 = 1) as b from documents where source is not null group by source)
        select source, cast(null as bigint) as batch, case when least(a, b) < 1 then 'too small' else '1 notices' end as said from c
        union all select source, 22, case when least(a, b) < 22 then 'too small' else '0 notices' end from c""",
    "output_plan": """with n as (select distinct lang || '.' || source as stem from documents), kinds(said) as (values ('planned'), ('collides'))
        select stem || '.txt' as name, stem || '.ko.txt' as output, said from n, kinds""",
    "constants": f"""select unnest(['budget 1', 'budget 512', 'budget 1024', 'metric', 'prompt', 'decoding']) as name,
        unnest(['2', '1024', '2048', '{{"beta":2.0,"char_order":6,"corpus_aggregation":"micro","name":"chrF","normalization":"NFC","scale":"0-100","whitespace":"stripped-before-ngrams","word_order":0}}',
            sha256('[{{"content":"{records.INSTRUCTION}","role":"system"}},{{"content":"{SHAPE.mark}","role":"user"}}]'), sha256('{{"max_tokens":512,"repeats":2}}')]) as value""",
    "probe_run": "select unnest(range(0, {n})) as pos, unnest([{p}]) as text, upper(unnest([{p}])) as said".format(n=len(readers.PROBES), p=", ".join(f"'{p}'" for p in readers.PROBES)),
    "first_rows": "select doc_id as line, n_chars from documents order by doc_id limit 100",
    "stream_pairs": f"""with {_PAIRS}, cut as (select {_STRIP.format(_FLAT_HEAD.format("source", 3))} as s, {_STRIP.format(_FLAT_HEAD.format("target", 2))} as t from pairs)
        select distinct s as source_key, t as target_key from cut where s <> '' and t <> '' and not starts_with(s, '#')""",
    "stream_breaker": f"with {_LINES} select doc_id, index, ok, aborted from judged",
}
