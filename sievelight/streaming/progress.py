"""Progress of stages, and cancelling what runs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Cancelled(RuntimeError):
    """The run was cancelled."""


@dataclass
class Progress:
    """Events of a run's stages in order. The share that is done never falls, whatever a stage reports."""

    weights: dict[str, float]
    on_event: Callable[[dict], None] = lambda event: None
    events: list[dict] = field(default_factory=list)
    _done: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def report(self, stage: str, share: float, note: str = "") -> None:
        """``share`` of the stage is done; stages before it are done, whether they said so or not."""
        with self._lock:
            names, total = list(self.weights), sum(self.weights.values())
            before = sum(self.weights[n] for n in names[: names.index(stage)])
            self._done = max(self._done, (before + self.weights[stage] * min(1.0, max(0.0, share))) / total)
            event = {"number": len(self.events), "stage": stage, "share": share, "overall": self._done, "note": note}
            self.events.append(event)
        self.on_event(event)


class Run:
    """A run of Spark jobs under a tag of its own, which may be cancelled from any thread."""

    def __init__(self, spark: SparkSession, tag: str, progress: Progress):
        self.spark, self.tag, self.progress = spark, tag, progress
        self._cancelled = threading.Event()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """The jobs begun within belong to the run; nothing begins once it is cancelled."""
        if self._cancelled.is_set():
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        self.progress.report(name, 0.0)
        try:
            yield
        except Exception as e:
            if self._cancelled.is_set():
                raise Cancelled(self.tag) from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if self._cancelled.is_set():
            raise Cancelled(self.tag)
        self.progress.report(name, 1.0)

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


class StreamProgress(StreamingQueryListener):
    """Reports the triggers of one streaming query as progress of a stage, given how many rows there are to read."""

    def __init__(self, progress: Progress, stage: str, rows: int, query: str | None = None):
        self.progress, self.stage, self.rows, self.query, self.seen = progress, stage, rows, query, 0

    def onQueryStarted(self, event) -> None:
        if self.query is None or event.name == self.query:
            self.progress.report(self.stage, 0.0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query is None or p.name == self.query:
            self.seen += p.numInputRows
            self.progress.report(self.stage, self.seen / max(1, self.rows), f"trigger {p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.progress.report(self.stage, self.seen / max(1, self.rows), "failed" if event.exception else "ended")
