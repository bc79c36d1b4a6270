"""Sources: pair files, JSONL with line numbers, documents, run records.

Files are read by Spark's readers, so any path that those open will do; lines are cut in the JVM. Files of
lines are read in blocks, documents whole. A line's place is (``file``, ``line``), which is the corpus's order.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parquill.errors import InputError, RecordError, SchemaError, SourceReadError
from parquill.functions.text import key, length_problem, payload, strip
from parquill.operators import records
from parquill.operators.compare import VERDICTS
from parquill.runtime import checkpoint

#: What parts a pair's sides, and what begins a comment.
DELIMITER, COMMENT, SUFFIX = "|||", "#", ".txt"
#: Keys of a run record.
RUN_KEYS = ("schema_version", "run_id", "created_at", "test_set", "prompt_shape_fingerprint", "decoding", "arms", "metric", "scores", "comparison")
UTF8 = ("utf-8", "utf8", "utf-8-sig")
#: Suffixes of files whose lines are read in blocks; others may be unpacked by Spark's text reader.
LINED = (SUFFIX, ".jsonl")


def resolve_inputs(inputs: Sequence[str | Path]) -> tuple[list[str], list[str]]:
    """Files in order, and those skipped: a directory gives its ``.txt`` files by name, a file itself."""
    files, skipped = [], []
    for entry in map(Path, inputs):
        if entry.is_dir():
            for child in sorted((c for c in entry.iterdir() if c.is_file()), key=lambda c: c.name):
                (files if child.suffix == SUFFIX else skipped).append(str(child))
        elif entry.is_file():
            files.append(str(entry))
        else:
            raise InputError([f"{entry}: no such file or directory"])
    return files, skipped


def files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, path, valid, text) of whole files: BOM dropped, line ends as \\n; text null unless valid UTF-8.

    A path that is given twice is read twice, as two files.
    """
    out = None
    for i, path in enumerate(paths):
        one = spark.read.format("binaryFile").load(str(path)).select(F.lit(i).alias("file"), F.lit(str(path)).alias("path"), "content")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], "file int, path string, valid boolean, text string")
    return out.select("file", "path", *decoded_utf8(F.col("content")))


def decoded_utf8(content: Column) -> tuple[Column, Column]:
    """Of a file's bytes: ``valid``, and ``text`` without a byte-order mark and with \\n as line end, null unless valid UTF-8."""
    good = F.is_valid_utf8(content.cast("string"))
    text = F.regexp_replace(F.regexp_replace(content.cast("string"), "^\ufeff", ""), "\r\n?", "\n")
    return good.alias("valid"), F.when(good, text).alias("text")


def lines(whole: DataFrame) -> DataFrame:
    """(file, path, line, raw), lines from 1; the empty piece after a last line's end is no line."""
    parts = F.split("text", "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return whole.filter("valid").select("file", "path", F.posexplode(kept).alias("at", "raw")).select("file", "path", (F.col("at") + 1).alias("line"), "raw")


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, path, line, raw, valid) of all lines as ``lines`` cuts them, and ``valid``, whether a line is valid UTF-8.

    Files are read in blocks, so none is one row or one task, whatever its size. Lines are numbered by the
    lines of the blocks before and their place in their own. What was read is kept first: another reading may
    be cut into other blocks. Files that Spark's text reader might unpack are read whole.
    """
    out = None
    for i, path in enumerate(map(str, paths)):
        where = [F.lit(i).alias("file"), F.lit(path).alias("path")]
        if Path(path).suffix in LINED:
            one = spark.read.text(path).select(*where, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"), F.is_valid_utf8("value").alias("valid"))
        else:
            whole = spark.read.format("binaryFile").load(path).select(*where, "content").select("file", "path", *decoded_utf8(F.col("content")))
            bad = whole.filter("not valid").select("file", "path", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("at"), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("valid"))
            one = lines(whole).select("file", "path", F.lit(0).cast("long").alias("block"), F.col("line").cast("long").alias("at"), "raw", F.lit(True).alias("valid")).union(bad)
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], "file int, path string, line long, raw string, valid boolean")
    kept = checkpoint(out)
    blocks = kept.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a block
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(blocks.select("_file", "_block", (earlier - F.col("first") + 1).alias("shift")))
    return kept.join(shift, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select("file", "path", (F.col("at") + F.col("shift")).alias("line"), "raw", "valid")


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's text, as ``files`` has it, through one small buffer of the driver's JVM."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), sha)
    plain = jvm.org.apache.commons.io.input.BOMInputStream(jvm.java.io.BufferedInputStream(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), 1 << 16))
    source = jvm.org.apache.commons.io.input.UnixLineEndingInputStream(plain, False)
    try:
        source.transferTo(out)
    finally:
        source.close()
    return bytes(sha.digest()).hex()


def read_pairs(spark: SparkSession, paths: Sequence[str], *, max_length_ratio: float = 8.0, max_chars: int | None = None) -> DataFrame:
    """Pair files, one row for each line that is neither blank nor a comment, and for each unreadable file.

    Columns: file, path, line, source, target, source_key, target_key, problem. ``problem`` is the first
    of: ``encoding``, ``delimiter``, ``left``, ``right`` (that side is empty), ``ratio``, ``chars``.
    """
    return pairs_in(read_lines(spark, paths), max_length_ratio=max_length_ratio, max_chars=max_chars)


def pairs_in(read: DataFrame, *, max_length_ratio: float = 8.0, max_chars: int | None = None) -> DataFrame:
    """``read_pairs`` of lines that ``read_lines`` gave."""
    bad = F.broadcast(read.filter("not valid").select("file", "path").distinct())  # a row a file at most
    return _pairs(read.join(bad, ["file", "path"], "left_anti"), bad, max_length_ratio, max_chars)


def pairs_of(whole: DataFrame, *, max_length_ratio: float = 8.0, max_chars: int | None = None) -> DataFrame:
    """``read_pairs`` of files that are rows already, as ``files`` gives them."""
    return _pairs(lines(whole), whole.filter("not valid"), max_length_ratio, max_chars)


def _pairs(cut_lines: DataFrame, bad_files: DataFrame, max_length_ratio: float, max_chars: int | None) -> DataFrame:
    used = cut_lines.withColumn("s", strip(F.col("raw"))).filter((F.col("s") != "") & ~F.startswith("s", F.lit(COMMENT)))
    sides = F.split("s", r"\|\|\|", -1)
    cut = used.withColumn("sides", sides).withColumn("source", payload(F.get("sides", F.lit(0)))).withColumn("target", payload(F.get("sides", F.lit(1))))
    problem = (
        F.when(F.size("sides") != 2, "delimiter").when(F.col("source") == "", "left").when(F.col("target") == "", "right")
        .otherwise(length_problem(F.col("source"), F.col("target"), max_length_ratio, max_chars))
    )
    pairs = cut.select("file", "path", "line", "source", "target", key(F.col("source")).alias("source_key"), key(F.col("target")).alias("target_key"), problem.alias("problem"))
    null = F.lit(None).cast("string")
    bad = bad_files.select("file", "path", F.lit(0).alias("line"), *[null.alias(c) for c in ("source", "target", "source_key", "target_key")], F.lit("encoding").alias("problem"))
    return pairs.union(bad)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw, schema, problem) of a JSONL file's lines; blank ones are counted but left out."""
    read = read_lines(spark, [path])
    bad = F.broadcast(read.filter("not valid").select("file").distinct())
    rows = read.join(bad, "file", "left_anti").filter(strip(F.col("raw")) != "")
    schema, problem = records.classify(F.col("raw"))
    return rows.select("line", "raw", schema.alias("schema"), problem.alias("problem"))


def read_split(spark: SparkSession, path: str, shape: records.PromptShape) -> DataFrame:
    """(line, source, target, problem) of a split file; ``problem`` null where the row is a record of the shape."""
    messages = records.messages_of(F.col("raw"))
    source, target = records.parse_record(messages, shape)
    rows = read_jsonl(spark, path).withColumn("why", F.coalesce("problem", records.record_problem(messages, shape)))
    return rows.select("line", F.when(F.col("why").isNull(), source).alias("source"), F.when(F.col("why").isNull(), target).alias("target"), F.col("why").alias("problem"))


def load_split(spark: SparkSession, path: str, shape: records.PromptShape) -> DataFrame:
    """``read_split``, refused at its first bad row, and where there is no file or no row."""
    try:
        split = read_split(spark, path, shape)
        empty = not split.limit(1).count()
    except AnalysisException as error:
        raise SchemaError(f"{path}: no such file") from error
    if empty:
        raise SchemaError(f"{path}: no records")
    if bad := split.filter("problem is not null").orderBy("line").first():
        raise SchemaError(f"{path}:{bad['line']}: {bad['problem']}")
    return split.select("line", "source", "target")


def decoded(content: Column, encoding: str) -> Column:
    """Bytes as text by any of Python's codecs; null where they are not valid."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                return None

        return values.map(one)

    return decode(content)


def read_documents(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8-sig") -> DataFrame:
    """(file, path, text) of whole documents, line ends as \\n; refused if one is not valid in the encoding."""
    "".encode(encoding)
    if encoding.lower() in UTF8:
        whole = files(spark, paths)
    else:
        whole = None
        for i, path in enumerate(paths):
            one = spark.read.format("binaryFile").load(str(path)).select(F.lit(i).alias("file"), F.lit(str(path)).alias("path"), F.regexp_replace(decoded(F.col("content"), encoding), "\r\n?", "\n").alias("text"))
            whole = one if whole is None else whole.union(one)
    if bad := whole.filter("text is null").orderBy("file").first():
        raise SourceReadError(f"{bad['path']} is not valid {encoding}")
    return whole.select("file", "path", "text")


def read_run(spark: SparkSession, path: str) -> dict:
    """A run record, refused if it is incomplete."""
    import json

    whole = files(spark, [path]).first()
    try:
        record = json.loads(whole["text"])
    except (TypeError, ValueError) as error:
        raise RecordError(f"{path}: unreadable ({error})") from error
    if not isinstance(record, dict):
        raise RecordError(f"{path}: not an object")
    if missing := [k for k in RUN_KEYS if k not in record]:
        raise RecordError(f"{path}: without {', '.join(missing)}")
    if not isinstance(record["comparison"], dict) or record["comparison"].get("verdict") not in VERDICTS:
        raise RecordError(f"{path}: unknown verdict")
    return record


#: The probe set, which is compared from run to run.
PROBES = (
    "Здравствуйте, как дела?",
    "Извините, я опоздал — на дорогах пробки.",
    "Не откладывай на завтра то, что можно сделать сегодня.",
    "Он обещал золотые горы, но в итоге всё осталось на словах.",
    "Марина оставила ключи соседке, потому что уезжала на неделю; та потом отдала их брату.",
    "Инженер собрал прототип, показал его команде, и они решили, что он готов к испытаниям.",
    "Модель загружается один раз и остаётся в памяти, поэтому первый запрос заметно медленнее.",
    "Квантование до четырёх бит уменьшает объём весов примерно вчетверо ценой части точности.",
)


def probes(spark: SparkSession, sentences: Sequence[str] = PROBES) -> DataFrame:
    """(pos, text) of the probe set, in order."""
    return spark.createDataFrame(list(enumerate(sentences)), "pos int, text string")


def run_probes(translate, sentences: Sequence[str] = PROBES) -> tuple[str, ...]:
    """Probe translations in order, by a function of one sentence."""
    return tuple(translate(s) for s in sentences)
