"""Training records: building them, reading them back, and classifying foreign ones."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAT, COMPLETIONS, TEXT = "chat", "completions", "text"
ROLES = ("system", "user", "assistant")
MESSAGES = "array<struct<content:string,role:string>>"
#: Fixed value: the system message of records, which adapters are fitted to.
INSTRUCTION = (
    "Translate the following Russian text into Korean. Reply with the Korean translation only, with no explanation, "
    "no transliteration, and no restatement of the source."
)


@dataclass(frozen=True)
class PromptShape:
    """The messages before an answer. ``mark`` stands for the source where the shape is measured."""

    instruction: str = INSTRUCTION
    mark: str = "«SOURCE-TEXT»"

    def messages(self, source: str) -> list[dict[str, str]]:
        return [{"role": "system", "content": self.instruction}, {"role": "user", "content": source}]

    def fingerprint(self) -> str:
        """SHA-256 of the marked messages as compact JSON with sorted keys."""
        return digest_of(self.messages(self.mark))

    def column(self, source: Column) -> Column:
        """The messages as a column, with fields in sorted order."""
        message = lambda role, content: F.struct(content.alias("content"), F.lit(role).alias("role"))
        return F.array(message("system", F.lit(self.instruction)), message("user", source))


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest_of(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def build_record(source: Column, target: Column, shape: PromptShape) -> Column:
    """A pair as chat messages; null where the source holds the shape's mark."""
    answer = F.struct(target.alias("content"), F.lit("assistant").alias("role"))
    return F.when(~F.contains(source, F.lit(shape.mark)), F.concat(shape.column(source), F.array(answer)))


def render_record(messages: Column) -> Column:
    """One JSON line: role before content, compact, non-ASCII as it is."""
    ordered = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.to_json(F.struct(ordered.alias("messages")), {"ignoreNullFields": "false"})


def record_problem(messages: Column, shape: PromptShape) -> Column:
    """Why messages are no record of this shape, in order of checks; null if they are."""
    reference = shape.messages(shape.mark)
    before, _, after = reference[1]["content"].partition(shape.mark)
    content = F.coalesce(F.get(messages, 1)["content"], F.lit(""))
    first = F.get(messages, 0)
    return (
        F.when(messages.isNull(), "no messages")
        .when(F.size(messages) != 3, "message count")
        .when(~first["role"].eqNullSafe(F.lit("system")) | ~first["content"].eqNullSafe(F.lit(shape.instruction)), "message 0")
        .when(~F.get(messages, 1)["role"].eqNullSafe(F.lit("user")), "carrier role")
        .when(~F.startswith(content, F.lit(before)) | ~F.endswith(content, F.lit(after)), "affixes")
        .when(~F.get(messages, 2)["role"].eqNullSafe(F.lit("assistant")), "answer role")
    )


def parse_record(messages: Column, shape: PromptShape) -> tuple[Column, Column]:
    """Source and target of a record; absent contents are empty."""
    before, _, after = shape.messages(shape.mark)[1]["content"].partition(shape.mark)
    content = F.coalesce(F.get(messages, 1)["content"], F.lit(""))
    cut = len(before) + len(after)
    source = F.substring(content, F.lit(len(before) + 1), F.length(content) - cut) if cut else content
    return source, F.coalesce(F.get(messages, 2)["content"], F.lit(""))


def classify(line: Column) -> tuple[Column, Column]:
    """Schema of a JSON line (null if none) and the problem (null if none).

    ``messages`` decides even where it is malformed; then completions, then text. Other keys are allowed
    beside those, but not inside a message.
    """
    v = F.try_parse_json(line)
    keys = F.json_object_keys(line)
    has = lambda key: F.coalesce(F.array_contains(keys, key), F.lit(False))
    messages = F.get_json_object(line, "$.messages")
    parts = F.from_json(messages, "array<string>")
    message_keys = F.transform(parts, lambda m: F.array_sort(F.json_object_keys(m)))
    good_keys = F.coalesce(F.forall(message_keys, lambda k: k.eqNullSafe(F.array(F.lit("content"), F.lit("role")))), F.lit(False))
    raw = lambda m, key: F.schema_of_variant(F.try_variant_get(F.try_parse_json(m), f"$.{key}", "variant"))
    strings = F.coalesce(F.forall(parts, lambda m: (raw(m, "role") == "STRING") & (raw(m, "content") == "STRING")), F.lit(False))
    roles = F.coalesce(F.forall(parts, lambda m: F.get_json_object(m, "$.role").isin(*ROLES)), F.lit(False))
    kind = F.schema_of_variant(v)
    string = lambda key: has(key) & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.lit(False))
    listed = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.messages", "variant")), F.lit("ARRAY")), F.lit(False))
    problem = (
        F.when(v.isNull(), "not JSON")
        .when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
        .when(has("messages") & (~listed | F.coalesce(F.size(parts) == 0, F.lit(True))), "messages not a non-empty list")
        .when(has("messages") & ~good_keys, "message keys")
        .when(has("messages") & ~strings, "message types")
        .when(has("messages") & ~roles, "message roles")
        .when(~has("messages") & ~(string("prompt") & string("completion")) & ~string("text"), "no schema")
    )
    schema = F.when(problem.isNull(), F.when(has("messages"), CHAT).when(string("prompt") & string("completion"), COMPLETIONS).otherwise(TEXT))
    return schema, problem


def uniformity(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What classified rows (``line``, ``schema``, ``problem``) of a file are, or of each file told apart by ``by``.

    ``schema`` is that of the earliest good row. ``error`` is null, or why the file is refused, at line
    ``error_line``: the first bad row's problem, which wins, or ``mixed`` where the second schema begins.
    """
    firsts = lines.groupBy(*(by or []), "schema").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.min(F.struct("line", "problem")).alias("p"))
    grouped = firsts.groupBy(*(by or [])).agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("schema").isNotNull(), F.struct("line", "schema")))).alias("s"), F.min(F.when(F.col("schema").isNull(), F.col("p"))).alias("bad")
    )
    other = F.get("s", F.lit(1))
    error = F.when(F.col("bad").isNotNull(), F.col("bad.problem")).when(other.isNotNull(), "mixed")
    line = F.coalesce("bad.line", other["line"])
    return grouped.select(*(by or []), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.get("s", F.lit(0))["schema"].alias("schema"), error.alias("error"), line.alias("error_line"), other["schema"].alias("other_schema"))


def messages_of(line: Column) -> Column:
    """A JSON line's messages, typed; parsed strictly enough only after ``classify``."""
    return F.from_json(F.get_json_object(line, "$.messages"), MESSAGES)
