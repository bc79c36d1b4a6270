"""Command line: translate, prepare-data, validate-data, train, evaluate. Exits 0, 1 (failed) or 2 (usage)."""

from __future__ import annotations

import argparse
import functools
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from parquill import runtime, training
from parquill.errors import EngineError, FileError
from parquill.functions.chunker import BUDGET_TOKENS
from parquill.operators.mapping import translator
from parquill.plans import documents, evaluate, prepare, validate
from parquill.translator import MAX_TOKENS, Translator


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="parquill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    t = sub.add_parser("translate", help="translate a text, standard input, or files")
    t.add_argument("text", nargs="?")
    for flag in ("--model", "--adapter-path", "--output", "--output-dir"):
        t.add_argument(flag)
    t.add_argument("--input", action="append", default=[], dest="inputs")
    t.add_argument("--max-tokens", type=int)
    t.add_argument("--chunk-budget", type=int, default=BUDGET_TOKENS)
    t.add_argument("--encoding", default="utf-8-sig")
    t.add_argument("--progress", action=argparse.BooleanOptionalAction)
    for flag in ("--force", "--allow-provenance-mismatch"):
        t.add_argument(flag, action="store_true")

    p = sub.add_parser("prepare-data", help="pair files to splits")
    p.add_argument("inputs", nargs="*", default=["data/derived"])
    p.add_argument("--output-dir", default="data/splits")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--valid-fraction", type=float, default=0.1)
    p.add_argument("--test-fraction", type=float, default=0.1)
    p.add_argument("--max-length-ratio", type=float, default=8.0)
    p.add_argument("--max-chars", type=int)
    for flag in ("--allow-source-conflicts", "--overwrite"):
        p.add_argument(flag, action="store_true")

    v = sub.add_parser("validate-data", help="check a split directory")
    v.add_argument("--data", default="data/splits")

    f = sub.add_parser("train", help="check splits and launch training")
    f.add_argument("--data", default="data/splits")
    for flag in ("--model", "--adapter-path"):
        f.add_argument(flag)
    f.add_argument("--run-name", default="current")
    for flag in ("--iters", "--batch-size", "--num-layers", "--max-seq-length", "--seed"):
        f.add_argument(flag, type=int)
    f.add_argument("--learning-rate", type=float)
    for flag in ("--mask-prompt", "--grad-checkpoint", "--overwrite"):
        f.add_argument(flag, action="store_true")

    e = sub.add_parser("evaluate", help="compare base and adapter on a test split")
    e.add_argument("--test-file", default="data/splits/test.jsonl")
    for flag in ("--adapter-path", "--model"):
        e.add_argument(flag)
    for flag in ("--limit", "--bootstrap-seed"):
        e.add_argument(flag, type=int)
    e.add_argument("--repeats", type=int, default=2)
    e.add_argument("--max-tokens", type=int, default=MAX_TOKENS)
    e.add_argument("--out", default="data/eval")
    e.add_argument("--allow-provenance-mismatch", action="store_true")
    return top


def _function(model: str | None, adapter: str | None, mismatch: bool, max_tokens: int | None, per_chunk: bool) -> Callable[[str], str]:
    """A translating function; with ``per_chunk`` the ceiling follows the text unless it was given."""
    made = Translator(model, adapter=adapter, allow_mismatch=mismatch)

    def run(text: str) -> str:
        return made.translate(text, max_tokens=max_tokens or (max(MAX_TOKENS, len(text)) if per_chunk else MAX_TOKENS))

    return run


def main(argv: list[str] | None = None, *, make: Callable[..., Callable[[str], str]] = _function, spark: SparkSession | None = None, runner: Callable[[list[str]], int] | None = None) -> int:
    """``make`` and ``runner`` stand for model and trainer in tests."""
    top = parser()
    a = top.parse_args(argv)
    if a.command == "translate":
        if a.text is not None and a.text != "-" and a.inputs:
            top.error("text and --input exclude each other")
        if (a.output or a.output_dir) and not a.inputs or a.output and len(a.inputs) != 1 or a.output and a.output_dir:
            top.error("--output needs exactly one --input, --output-dir at least one, and they exclude each other")
        if len(a.inputs) > 1 and not a.output_dir:
            top.error("several inputs need --output-dir")
        if not a.inputs:
            text = (sys.stdin.read() if a.text in (None, "-") else a.text).strip()
            if not text:
                top.error("nothing to translate")
    runtime.ship("parquill")
    spark = spark or SparkSession.builder.appName("parquill").getOrCreate()
    try:
        return _run(a, spark, make, runner, text if a.command == "translate" and not a.inputs else None)
    except FileError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    except EngineError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession, make: Callable[..., Callable[[str], str]], runner: Callable | None, text: str | None) -> int:
    if a.command == "translate":
        build = functools.partial(make, a.model, a.adapter_path, a.allow_provenance_mismatch, a.max_tokens)
        if text is not None:
            print(build(False)(text))
            return 0
        import tempfile
        from pathlib import Path

        from parquill.sources import sinks

        tell = (lambda p: print(f"{p.source_name}: {p.file_index + 1}/{p.file_total}, {p.phase} {p.chunks_done}/{p.chunks_total}{'' if p.ok else ', FAILED'}", file=sys.stderr)) if a.progress or a.progress is None and sys.stderr.isatty() else None
        options = {"encoding": a.encoding, "budget_tokens": a.chunk_budget, "progress": tell}
        if a.output_dir:
            failed = documents.translate_files(spark, a.inputs, a.output_dir, functools.partial(build, True), force=a.force, **options)
        else:
            if a.output:
                sinks.check_destination(Path(a.output), Path(a.inputs[0]), force=a.force)
            with tempfile.TemporaryDirectory() as folder:
                failed = documents.translate_files(spark, a.inputs, folder, functools.partial(build, True), force=True, **options)
                done = sinks.output_path(a.inputs[0], folder).read_text(encoding="utf-8")
            if a.output:
                sinks.write_text(a.output, done, source=a.inputs[0], force=a.force)
            else:
                sys.stdout.write(done)
        for source, chunks in failed.items():
            if chunks:
                print(f"{source}: untranslated chunks {', '.join(map(str, chunks))}", file=sys.stderr)
        return int(any(failed.values()))
    if a.command == "prepare-data":
        config = prepare.PrepareConfig(tuple(a.inputs), a.output_dir, a.seed, a.valid_fraction, a.test_fraction, a.max_length_ratio, a.max_chars, a.allow_source_conflicts, a.overwrite)
        result = prepare.prepare_splits(spark, config)
        print(prepare.render_report(result))
        for line in (*result.duplicates, *result.conflicts):
            print(line, file=sys.stderr)
        return 0
    if a.command == "validate-data":
        report = validate.validate_split_dir(spark, a.data)
        print("\n".join([f"{n}: {k} rows" for n, k in report.rows.items()] + list(report.notices)))
        return 0
    if a.command == "train":
        config = training.TrainingConfig(a.data, a.model, a.adapter_path, a.run_name, a.iters, a.batch_size, a.learning_rate, a.num_layers, a.max_seq_length, a.seed, a.mask_prompt, a.grad_checkpoint, a.overwrite)
        to, report = training.train_adapter(spark, config, runner=runner)
        print("\n".join([str(to), *report.notices]))
        return 0
    config = evaluate.EvaluationConfig(a.test_file, a.adapter_path, a.model, a.limit, a.repeats, a.max_tokens, a.out, a.allow_provenance_mismatch, a.bootstrap_seed)
    arms = {
        evaluate.BASE: translator(functools.partial(make, a.model, None, False, a.max_tokens, False)),
        evaluate.ADAPTER: translator(functools.partial(make, a.model, a.adapter_path, a.allow_provenance_mismatch, a.max_tokens, False)),
    }
    say = functools.partial(print, file=sys.stderr)
    record = evaluate.evaluate_pair(spark, config, arms, report=say, warn=say)
    print(f"{evaluate.render_summary(record)}\n{evaluate.write_run(record, a.out)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
