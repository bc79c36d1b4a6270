"""Corpus preparation: pair files to leakage-free, reproducible splits with a manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquill.errors import InputError
from parquill.operators.dedupe import mark_duplicates
from parquill.operators.records import PromptShape
from parquill.operators.split import SplitPlan, assign_splits, ratio_and_length_stats
from parquill.runtime import checkpoint
from parquill.sources import readers, sinks

#: Problems and notices that are listed one by one; the rest are counted. They are read by people.
LISTED = 1_000


@dataclass(frozen=True)
class PrepareConfig:
    inputs: tuple[str, ...] = ("data/derived",)
    output_dir: str = "data/splits"
    seed: int = 0
    valid_fraction: float = 0.1
    test_fraction: float = 0.1
    max_length_ratio: float = 8.0
    max_chars: int | None = None
    allow_source_conflicts: bool = False
    overwrite: bool = False
    shape: PromptShape = PromptShape()


@dataclass(frozen=True)
class PrepareResult:
    manifest: dict
    output_dir: str
    written: tuple[str, ...]
    duplicates: tuple[str, ...]
    conflicts: tuple[str, ...]
    skipped: tuple[str, ...]
    ratio_stats: tuple[float, float, float]
    length_stats: tuple[int, int, int]
    per_input: tuple[tuple[str, int], ...]


def _located(rows: DataFrame) -> list[str]:
    """Lines for people: where, what, and of which row."""
    some = rows.orderBy("file", "line").limit(LISTED).select("path", "line", "status", "of").collect()
    return [f"{r['path']}:{r['line']}: {r['status']} of {r['of']['path']}:{r['of']['line']}" for r in some]


def prepare_frames(pairs: DataFrame, config: PrepareConfig) -> tuple[DataFrame, DataFrame]:
    """Marked rows and split rows of pairs with file, path, line, payloads and keys; both distributed."""
    marked = checkpoint(mark_duplicates(pairs, ("file", "line", "path"), allow_conflicts=config.allow_source_conflicts))
    kept = marked.filter(F.col("status").isin("keep", "conflict")).drop("status", "of")
    return marked, assign_splits(kept, seed=config.seed, valid_fraction=config.valid_fraction, test_fraction=config.test_fraction)


def prepare_splits(spark: SparkSession, config: PrepareConfig) -> PrepareResult:
    """Reads, checks, removes duplicates, splits and writes; nothing is written while any row is a problem."""
    SplitPlan.of(10**9, config.valid_fraction, config.test_fraction)
    folder = sinks.resolve_output(config.output_dir)
    paths, skipped = readers.resolve_inputs(config.inputs)
    read_lines = readers.read_lines(spark, paths)
    read = checkpoint(readers.pairs_in(read_lines, max_length_ratio=config.max_length_ratio, max_chars=config.max_chars))
    sentinel = F.contains("source", F.lit(config.shape.mark))
    bad = read.withColumn("problem", F.coalesce("problem", F.when(sentinel, "sentinel"))).filter("problem is not null")
    problems = [f"{r['path']}:{r['line']}: {r['problem']}" for r in bad.orderBy("file", "line").limit(LISTED).collect()]
    good = read.filter("problem is null")
    marked = checkpoint(mark_duplicates(good, ("file", "line", "path"), allow_conflicts=config.allow_source_conflicts))
    clashes = marked.filter("status = 'problem'")
    problems += [f"{x}, with another target" for x in _located(clashes)]
    if problems:
        raise InputError(problems)
    kept = marked.filter(F.col("status").isin("keep", "conflict"))
    if not kept.limit(1).count():
        raise InputError([f"no pairs in {len(paths)} files"])
    split = checkpoint(assign_splits(kept, seed=config.seed, valid_fraction=config.valid_fraction, test_fraction=config.test_fraction))
    if folder.exists() and not config.overwrite:
        sinks.refuse_to_clobber(folder)

    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    planned = [n for n, _ in SplitPlan.of(sum(counts.values()), config.valid_fraction, config.test_fraction).sizes]
    by_file = {r["file"]: r["count"] for r in good.groupBy("file").count().collect()}
    lines_read = {r["file"]: r["count"] for r in read_lines.groupBy("file").count().collect()}
    digests = [readers.digest(spark, p) for p in paths]
    folder.mkdir(parents=True, exist_ok=True)
    outputs = []
    for name in planned:
        path = folder / sinks.SPLIT_FILES[name]
        sha = sinks.write_file(sinks.split_lines(split, name, config.shape), path)  # one file is the contract
        outputs.append({"name": path.name, "rows": counts.get(name, 0), "sha256": sha})
    status = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}
    manifest = {
        "seed": config.seed,
        "valid_fraction": config.valid_fraction,
        "test_fraction": config.test_fraction,
        "max_length_ratio": config.max_length_ratio,
        "max_chars": config.max_chars,
        "allow_source_conflicts": config.allow_source_conflicts,
        "prompt_shape_fingerprint": config.shape.fingerprint(),
        "inputs": [{"path": sinks.recorded(p), "sha256": digests[i], "lines_read": lines_read.get(i, 0), "pairs": by_file.get(i, 0)} for i, p in enumerate(paths)],
        "counts": {"pairs_read": sum(by_file.values()), "duplicates_dropped": status.get("duplicate", 0), "unique_sources": split.select("source_key").distinct().count(), **{n: counts.get(n, 0) for n in planned}},
        "outputs": outputs,
    }
    sinks.write_lines([json.dumps(manifest, ensure_ascii=False, indent=2)], folder / sinks.MANIFEST)
    for name, file in sinks.SPLIT_FILES.items():
        if name not in planned:
            (folder / file).unlink(missing_ok=True)
    stats = ratio_and_length_stats(split).first()
    return PrepareResult(
        manifest, str(folder), tuple([*[sinks.SPLIT_FILES[n] for n in planned], sinks.MANIFEST]),
        tuple(_located(marked.filter("status = 'duplicate'"))), tuple(_located(marked.filter("status = 'conflict'"))), tuple(skipped),
        (stats["min_ratio"], stats["median_ratio"], stats["max_ratio"]), (stats["min_length"], stats["median_length"], stats["max_length"]),
        tuple((p, by_file.get(i, 0)) for i, p in enumerate(paths)),
    )


def render_report(result: PrepareResult) -> str:
    """A summary for people."""
    c, r, n = result.manifest["counts"], result.ratio_stats, result.length_stats
    return "\n".join(
        [
            f"{len(result.written)} files in {result.output_dir}",
            *[f"  {path}: {k} pairs" for path, k in result.per_input],
            f"  read {c['pairs_read']}, duplicates {c['duplicates_dropped']}, sources {c['unique_sources']}",
            *[f"  {o['name']}: {o['rows']} rows" for o in result.manifest["outputs"]],
            f"  length ratio {r[0]:.2f} / {r[1]:.2f} / {r[2]:.2f}, source length {n[0]} / {n[1]} / {n[2]} (minimum, median, maximum)",
            *[f"  skipped {p}" for p in result.skipped],
        ]
    )


