"""Long runs that tell how far they are and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import NamedTuple, TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

T = TypeVar("T")
POLL_S = 0.2


class Cancelled(RuntimeError):
    """The run was cancelled."""


class Progress(NamedTuple):
    """Spark jobs of a run that have ended or are under way, and the tasks of the stages that are."""

    jobs: int
    tasks_done: int
    tasks: int


class Job:
    """Work on Spark under a tag of its own.

    ``on_progress`` hears of changes while the work runs, on another thread. All
    Spark jobs of the work, those of its tables among them, end on
    :meth:`cancel`; the work then raises :class:`Cancelled`. What it was about
    to publish as a version isn't.
    """

    def __init__(self, spark: SparkSession, on_progress: Callable[[Progress], None] | None = None) -> None:
        self.spark, self.on_progress = spark, on_progress
        self.tag = f"chronofold-{uuid.uuid4().hex}"
        self.cancelled = threading.Event()

    def cancel(self) -> None:
        """May be called from any thread, before, in or after the work."""
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """Raise if the work is cancelled; for places between Spark jobs, such as ``on_table``."""
        if self.cancelled.is_set():
            raise Cancelled(self.tag)

    def run(self, work: Callable[[], T]) -> T:
        context, done = self.spark.sparkContext, threading.Event()
        watcher = threading.Thread(target=self._watch, args=(done,), daemon=True)
        self.check()
        context.addJobTag(self.tag)
        watcher.start()
        try:
            out = work()
        except Exception:
            self.check()
            raise
        finally:
            context.removeJobTag(self.tag)
            done.set()
            watcher.join()
        self.check()
        return out

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        jobs = list(tracker.getJobIdsForTag(self.tag))
        done = tasks = 0
        for job in jobs:
            info = tracker.getJobInfo(job)
            if info.isDefined() and info.get().status().toString() == "RUNNING":
                for stage in info.get().stageIds():
                    found = tracker.getStageInfo(stage)
                    if found.isDefined():
                        done += found.get().numCompletedTasks()
                        tasks += found.get().numTasks()
        return Progress(len(jobs), done, tasks)

    def _watch(self, done: threading.Event) -> None:
        last = None
        while not done.wait(POLL_S):
            if self.cancelled.is_set():  # jobs that began after the call
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            now = self.progress()
            if now != last and self.on_progress:
                self.on_progress(now)
            last = now


class StreamProgress(StreamingQueryListener):
    """Tells of the micro-batches of all queries of a session: query, batch, rows read; add it by ``spark.streams.addListener``."""

    def __init__(self, on_batch: Callable[[str, int, int], None]) -> None:
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.on_batch(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        pass
