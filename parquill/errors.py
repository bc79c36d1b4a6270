"""Typed errors, one family for each part of the engine."""


class EngineError(Exception):
    """Base of all."""


class DatasetError(EngineError):
    """Dataset files."""


class RecordShapeError(DatasetError):
    """A record that the prompt shape did not produce."""


class SchemaError(DatasetError):
    """A line of none of the row shapes, or a file of more than one."""


class SplitLayoutError(DatasetError):
    """A split directory without its required file."""


class PrepareError(DatasetError):
    """Preparation of splits."""


class InputError(PrepareError):
    """Rows that cannot become records; ``problems`` has one line for each."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("\n".join(problems))
        self.problems = tuple(problems)


class OutputExistsError(PrepareError):
    """The output directory holds something already."""


class OutputPathError(PrepareError):
    """The output directory is inside a protected one."""


class EvaluationError(EngineError):
    """Evaluation."""


class SplitIntegrityError(EvaluationError):
    """The test split overlaps training data."""


class ConfoundedComparisonError(EvaluationError):
    """The arms differ in more than the adapter."""


class DecodingMismatchError(EvaluationError):
    """The arms decoded differently."""


class RecordError(EvaluationError):
    """An incomplete run record."""


class FileError(EngineError):
    """Files."""


class SourceReadError(FileError):
    """A source that cannot be read in the chosen encoding."""


class DestinationError(FileError):
    """A destination that writing would spoil."""


class AdapterProvenanceError(EngineError):
    """An adapter without usable provenance."""


class AdapterMismatchError(AdapterProvenanceError):
    """An adapter of another base or prompt shape."""


class TrainingError(EngineError):
    """Training launch."""


class SplitTooSmallError(TrainingError):
    """A split with fewer rows than a batch."""


class AdapterExistsError(TrainingError):
    """The output path holds weights."""


class AdapterPathError(TrainingError):
    """The output path is inside the data directory."""


class TrainerFailedError(TrainingError):
    """The trainer exited with an error."""


class TranslationError(EngineError, RuntimeError):
    """Inference."""


class TruncatedTranslationError(TranslationError):
    """Generation stopped before the model was done."""

    def __init__(self, *, max_tokens: int, partial_text: str, finish_reason: str | None) -> None:
        super().__init__(f"not finished within {max_tokens} tokens ({finish_reason})")
        self.max_tokens, self.partial_text, self.finish_reason = max_tokens, partial_text, finish_reason


class ReasoningLeakError(TranslationError):
    """A reasoning delimiter in the completion."""

    def __init__(self, delimiter: str, partial_text: str) -> None:
        super().__init__(f"the completion has the reasoning delimiter {delimiter!r}")
        self.delimiter, self.partial_text = delimiter, partial_text
