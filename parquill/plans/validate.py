"""Checking split directories before a run that costs hours."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parquill.errors import RecordShapeError, SchemaError, SplitLayoutError
from parquill.operators import records
from parquill.sources import readers
from parquill.sources.sinks import SPLIT_FILES


@dataclass(frozen=True)
class SplitReport:
    data_dir: str
    rows: dict[str, int]
    notices: tuple[str, ...]


def validate_schema(spark: SparkSession, path: str) -> str:
    """The one schema that all of a JSONL file's rows have."""
    if not Path(path).is_file():
        raise SchemaError(f"{path}: no such file")
    rows = readers.read_jsonl(spark, path)
    file = records.uniformity(rows).first()
    if not file["n_rows"]:
        raise SchemaError(f"{path}: no records")
    if file["error"] == "mixed":
        raise SchemaError(f"{path}:{file['error_line']}: {file['other_schema']} row in a {file['schema']} file")
    if file["error"]:
        raise SchemaError(f"{path}:{file['error_line']}: {file['error']}")
    return file["schema"]


def validate_training_file(spark: SparkSession, path: str, shape: records.PromptShape) -> int:
    """Number of rows, all of them chat records of this prompt shape."""
    schema = validate_schema(spark, path)
    if schema != records.CHAT:
        raise SchemaError(f"{path}: {schema} rows, but {records.CHAT} rows of this prompt shape are needed")
    rows = readers.read_split(spark, path, shape)
    seen = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col("problem").isNotNull(), F.struct("line", "problem"))).alias("bad")).first()
    if seen["bad"]:
        raise RecordShapeError(f"{path}:{seen['bad']['line']}: {seen['bad']['problem']}; prepare the splits again")
    return seen["n"]


def validate_split_dir(spark: SparkSession, folder: str, shape: records.PromptShape | None = None) -> SplitReport:
    """Rows of each split file: train is needed, valid is missed, test is optional."""
    shape, rows, notices = shape or records.PromptShape(), {}, []
    for name in ("train", "valid", "test"):
        path = Path(folder) / SPLIT_FILES[name]
        if path.is_file():
            rows[path.name] = validate_training_file(spark, str(path), shape)
        elif name == "train":
            raise SplitLayoutError(f"{path}: the required split is missing")
        elif name == "valid":
            notices.append(f"{path} is absent; there will be no validation loss")
    return SplitReport(str(folder), rows, tuple(notices))
