"""Parallel-text data engine on Spark: preparation, validation, scoring and chunking of text corpora."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

#: Public names by module; a module is loaded when one of its names is asked for.
_PUBLIC = {
    "adapters": "Provenance check_adapter provenance_path read_provenance resolve_adapter resolve_model write_provenance",
    "errors": "AdapterExistsError AdapterMismatchError AdapterPathError AdapterProvenanceError ConfoundedComparisonError DatasetError DecodingMismatchError DestinationError EngineError EvaluationError FileError InputError OutputExistsError OutputPathError PrepareError ReasoningLeakError RecordError RecordShapeError SchemaError SourceReadError SplitIntegrityError SplitLayoutError SplitTooSmallError TrainerFailedError TrainingError TranslationError TruncatedTranslationError",
    "functions.chrf": "parameters pooled relational_counts score segment_scores",
    "functions.chunker": "Chunk budget_chars chunk chunk_rows chunks marker reassemble render sentences token_ceiling with_progress",
    "functions.text": "canonical casefold collapse dense group_hash key length_problem length_ratio nfc payload strip",
    "operators.compare": "bootstrap_floor compare compare_runs join_arms spread tally verdict",
    "operators.dedupe": "conflicted_sources mark_duplicates",
    "operators.leakage": "containments overlap_summary overlaps split_digest without_leaked",
    "operators.mapping": "breaker completion_problem fold_tokens translate_documents translate_in_order translator",
    "operators.records": "PromptShape build_record classify parse_record record_problem render_record",
    "operators.split": "SplitPlan assign_splits ratio_and_length_stats split_counts",
    "plans.documents": "translate_files",
    "plans.evaluate": "EvaluationConfig check_isolation evaluate_pair render_summary write_run",
    "plans.prepare": "PrepareConfig PrepareResult prepare_splits render_report",
    "plans.validate": "SplitReport validate_schema validate_split_dir validate_training_file",
    "sources.readers": "PROBES load_split probes read_documents read_jsonl read_pairs read_run read_split resolve_inputs run_probes",
    "sources.sinks": "PartFile check_destination output_path plan_batch write_text",
    "training": "TrainingConfig build_argv preflight train_adapter",
    "translator": "Translator",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"parquill.{_HOME[name]}"), name)
