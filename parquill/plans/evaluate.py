"""Evaluation: a test split, translated by two arms, into a guarded verdict and a run record."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parquill import adapters
from parquill.errors import ConfoundedComparisonError, EvaluationError, SplitIntegrityError
from parquill.functions import chrf
from parquill.operators import compare, leakage, records
from parquill.runtime import checkpoint
from parquill.sources import readers, sinks

BASE, ADAPTER = "base", "adapter"
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class EvaluationConfig:
    test_file: str = "data/splits/test.jsonl"
    adapter_path: str | None = None
    model_id: str | None = None
    limit: int | None = None
    repeats: int = 2
    max_tokens: int = 512
    out_dir: str = "data/eval"
    allow_provenance_mismatch: bool = False
    bootstrap_seed: int | None = None
    shape: records.PromptShape = records.PromptShape()

    def decoding(self) -> dict[str, int]:
        return {"max_tokens": self.max_tokens, "repeats": self.repeats}


def check_isolation(spark: SparkSession, test: DataFrame, test_path: str, shape: records.PromptShape) -> tuple[str, ...]:
    """Names of the training splits beside the test file; refused if the test split overlaps one."""
    folder, others = Path(test_path).parent, {}
    for name in ("train", "valid"):
        path = folder / sinks.SPLIT_FILES[name]
        if path.is_file() and path.resolve() != Path(test_path).resolve():
            others[path.name] = readers.load_split(spark, str(path), shape)
    if not others:
        return ()
    found = [r for r in leakage.overlap_summary(test, others).collect() if r["hits"]]
    for name in others:
        if hits := [r for r in found if r["split"] == name]:
            detail = "; ".join(f"{r['hits']} shared {r['kind']}(s), first at {test_path}:{r['line']} = {name}:{r['other_line']}" for r in sorted(hits, key=lambda r: r["kind"] != "source"))
            raise SplitIntegrityError(f"{test_path} overlaps {name}: {detail}")
    return tuple(others)


def run_id(identity: dict, now: datetime) -> str:
    """When the run was, and a digest of what it was."""
    return f"{now:%Y%m%dT%H%M%SZ}-{records.digest_of(identity)[:12]}"


def limited(segments: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by line; a limit below 1 is refused."""
    if limit is not None and limit < 1:
        raise EvaluationError(f"limit {limit} leaves nothing to score")
    return segments.orderBy("line").limit(limit) if limit else segments


def chrf_scorer(rows: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], float]]:
    """Rows of ``output`` and ``target`` with ``score``, and the corpus score of such rows once they are kept."""
    return chrf.segment_scores(rows, "output", "target"), lambda kept: chrf.pooled(kept).first()["corpus_score"]


def run_arm(scored: DataFrame, translate: Callable[[Column], Column], repeats: int, scorer: Callable = chrf_scorer) -> tuple[DataFrame, list[float], float]:
    """The first pass's rows with output and score, each pass's corpus score, and seconds."""
    began, passes, first = time.monotonic(), [], None
    for _ in range(max(1, repeats)):
        out = scored.withColumn("_r", translate(F.col("source"))).withColumn("output", F.col("_r.text"))
        scored_rows, corpus = scorer(out)
        rows = checkpoint(scored_rows)
        if bad := rows.filter("not _r.ok").orderBy("line").first():
            raise EvaluationError(f"line {bad['line']}: {bad['_r']['error']}")
        passes.append(corpus(rows))
        first = rows if first is None else first
    return first.select("line", "output", "score"), passes, time.monotonic() - began


def evaluate_pair(
    spark: SparkSession, config: EvaluationConfig, arms: dict[str, Callable[[Column], Column]], *, clock: Callable[[], datetime] | None = None,
    scorer: Callable = chrf_scorer, report: Callable[[str], None] | None = None, warn: Callable[[str], None] | None = None,
) -> dict:
    """The run record. ``arms`` has for ``base`` and ``adapter`` a column function as ``mapping.translator`` makes.

    ``scorer`` stands for the metric, as ``chrf_scorer`` is one; ``report`` is told each step and ``warn``
    what makes the comparison doubtful.
    """
    tell, doubt = report or (lambda _: None), warn or (lambda _: None)
    model = adapters.resolve_model(config.model_id)
    adapter = adapters.resolve_adapter(config.adapter_path)
    if adapter is None:
        raise EvaluationError("no adapter to compare with")
    segments = checkpoint(readers.load_split(spark, config.test_file, config.shape))
    check_isolation(spark, segments, config.test_file, config.shape)
    whole = leakage.split_digest(segments).first()
    scored = limited(segments, config.limit)
    known = adapters.read_provenance(adapter)
    confounded = known is not None and known.base_model_id != model
    if confounded and not config.allow_provenance_mismatch:
        raise ConfoundedComparisonError(f"{adapter} was fitted to {known.base_model_id}, not {model}")
    if known is None:
        doubt(f"{adapter}: no provenance; its base cannot be checked")
    elif confounded:
        doubt(f"{adapter} was fitted to {known.base_model_id}, not {model}; going on as asked")
    n, done = scored.count(), {}
    for name in (BASE, ADAPTER):
        tell(f"{name}: {max(1, config.repeats)} passes over {n} rows")
        done[name] = run_arm(scored, arms[name], config.repeats, scorer)
        tell(f"{name}: corpus score {done[name][1][0]:.2f} (n={n})")
    both = compare.join_arms(done[BASE][0], done[ADAPTER][0])
    spreads = [max(s) - min(s) if len(s) >= 2 else None for _, s, _ in done.values()]
    row = compare.compare(both, done[BASE][1][0], done[ADAPTER][1][0], spreads=spreads, confounded=confounded, bootstrap_seed=config.bootstrap_seed).first()
    comparison = row.asDict()
    now = (clock or (lambda: datetime.now(tz=UTC)))()
    decoding = {"settings": config.decoding(), "fingerprint": records.digest_of(config.decoding())}
    identity = {"model_id": model, "adapter_path": adapter, "test_set_sha256": whole["digest"], "limit": config.limit, "decoding_fingerprint": decoding["fingerprint"], "prompt_shape_fingerprint": config.shape.fingerprint()}
    scores = {name: {"corpus_chrf": s[0], "n": n} for name, (_, s, _) in done.items()}
    return {
        "schema_version": SCHEMA_VERSION,
        "run_id": run_id(identity, now),
        "created_at": f"{now:%Y-%m-%dT%H:%M:%SZ}",
        "test_set": {"path": config.test_file, "sha256": whole["digest"], "n_lines": whole["n_lines"], "n_scored": n, "limit": config.limit, "subset": config.limit is not None},
        "prompt_shape_fingerprint": config.shape.fingerprint(),
        "decoding": decoding,
        "arms": {name: {"model_id": model, "adapter_path": adapter if name == ADAPTER else None, "corpus_chrf": s[0], "n": n, "repeat_scores": s, "seconds": t} for name, (_, s, t) in done.items()},
        "metric": chrf.parameters(),
        "scores": scores | {"delta": comparison["delta"], "n": n},
        "comparison": comparison,
        "confounded": confounded,
    }


def index_line(record: dict) -> dict:
    """What the index has of a run."""
    test = record["test_set"]
    return {
        "run_id": record["run_id"], "created_at": record["created_at"], "verdict": record["comparison"]["verdict"], "delta": record["comparison"]["delta"], "n": test["n_scored"],
        "scores": {a: x["corpus_chrf"] for a, x in record["arms"].items()}, "test_set_sha256": test["sha256"], "limit": test["limit"],
        "prompt_shape_fingerprint": record["prompt_shape_fingerprint"], "decoding_fingerprint": record["decoding"]["fingerprint"], "confounded": record["confounded"],
    }


def write_run(record: dict, folder: str) -> Path:
    return sinks.write_run(record, index_line(record), folder)


def render_summary(record: dict) -> str:
    """A summary for people; every score has its n."""
    c, n = record["comparison"], record["test_set"]["n_scored"]
    lines = [f"run {record['run_id']}: {record['test_set']['path']}, {n} of {record['test_set']['n_lines']} rows"]
    lines += [f"{name:8} chrF {arm['corpus_chrf']:6.2f} (n={n})" for name, arm in record["arms"].items()]
    lines += [f"delta    {c['delta']:+6.2f} (n={n}; floor {c['floor']:.2f} from {', '.join(sorted(c['floor_bases']))})"]
    lines += [f"{c['wins']} better, {c['losses']} worse, {c['ties']} tied; {c['distinguishable_fraction']:.0%} of outputs differ", f"verdict: {c['verdict']}"]
    return "\n".join(lines + [c["note"]] * bool(c["note"]))
