"""Progress of streams: what a run in flight has done, for people; no data depends on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


@dataclass(frozen=True)
class Step:
    """A phase (``start``, ``chunk_done``, ``done``), micro-batches and rows so far, and whether all went well."""

    phase: str
    batches: int
    rows: int
    ok: bool


class ProgressListener(StreamingQueryListener):
    """Tells a callback of each step of the session's streams: ``spark.streams.addListener(ProgressListener(tell))``."""

    def __init__(self, tell: Callable[[Step], None]) -> None:
        self._tell, self._seen = tell, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._seen[str(event.runId)] = (0, 0)
        self._tell(Step("start", 0, 0, True))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        run = str(event.progress.runId)
        batches, rows = self._seen.get(run, (0, 0))
        self._seen[run] = batches + 1, rows + event.progress.numInputRows
        self._tell(Step("chunk_done", *self._seen[run], True))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        """Nothing came in; nothing to tell."""

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._tell(Step("done", *self._seen.pop(str(event.runId), (0, 0)), event.exception is None))
