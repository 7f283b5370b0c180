"""Ending work early, and telling how far it is: for calls that gather, and for any action on a DataFrame.

    stop = Abort()
    run(spark, lambda: r.blocks([0]).count(), abort=stop, on_progress=print, total=r.header.record_count)

Another thread calls stop.abort(). The jobs of the call are a job group of their own, which is cancelled with its
tasks; the call raises AbortError, and its sources are closed.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from .errors import AbortError

T = TypeVar("T")
#: Seconds between two looks at the jobs of a call, and that abort() waits at most for the calls it ends.
LOOK, WAIT = 0.1, 10.0
_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


class Abort:
    """A wish to end; it may be given to several calls, and once made it holds for all later ones."""

    def __init__(self):
        self._wished, self._lock, self._reason = threading.Event(), threading.Lock(), None
        self._running: dict[str, SparkSession] = {}

    @property
    def aborted(self) -> bool:
        return self._wished.is_set()

    def check(self) -> None:
        if self.aborted:
            raise AbortError(self._reason)

    def abort(self, reason: str | None = None, wait: float = WAIT) -> None:
        """Ends the calls that hold this, and returns when they have ended or after `wait` seconds."""
        if not self.aborted:
            self._reason = reason
            self._wished.set()
        till = time.monotonic() + wait
        while True:  # a call may start another job meanwhile
            with self._lock:
                running = dict(self._running)
            for group, spark in running.items():
                spark.sparkContext.cancelJobGroup(group)
            if not running or time.monotonic() > till:
                return
            time.sleep(LOOK / 2)

    def _enter(self, group: str, spark: SparkSession) -> None:
        with self._lock:
            self._running[group] = spark
        self.check()

    def _leave(self, group: str) -> None:
        with self._lock:
            self._running.pop(group, None)


class _Watch:
    """Tells the share of a group's tasks that have ended, as a number of `total` that never goes back."""

    def __init__(self, spark: SparkSession, group: str, total: int, tell: Callable[[int, int], None]):
        self.tracker, self.group, self.total, self.tell = spark.sparkContext.statusTracker(), group, total, tell
        self.done, self.failed, self._over = -1, None, threading.Event()
        self.thread = threading.Thread(target=self._look, name=f"progress of {group}", daemon=True)
        self.thread.start()

    def share(self) -> float:
        ended = there = 0
        for job in self.tracker.getJobIdsForGroup(self.group):
            info = self.tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := self.tracker.getStageInfo(stage):
                    ended, there = ended + s.numCompletedTasks, there + s.numTasks
        return ended / there if there else 0.0

    def say(self, done: int) -> None:
        if done > self.done and not self.failed:
            self.done = done
            try:
                self.tell(done, self.total)
            except Exception as e:  # it is raised where the call is made
                self.failed = e

    def _look(self) -> None:
        while not self._over.wait(LOOK):
            self.say(min(self.total, int(self.total * self.share())))

    def end(self, well: bool) -> None:
        self._over.set()
        self.thread.join()
        if well:
            self.say(self.total)
            if self.failed:
                raise self.failed


def run(spark: SparkSession, action: Callable[[], T], abort: Abort | None = None, on_progress: Callable[[int, int], None] | None = None, total: int = 100) -> T:
    """What the action gives. on_progress is told (done, total), by the share of tasks that have ended; last (total, total)."""
    if abort is None and on_progress is None:
        return action()
    context, group, stop = spark.sparkContext, f"wavelake-{uuid.uuid4().hex}", abort or Abort()
    before = {k: context.getLocalProperty(k) for k in _GROUP}
    watch, well = None, False
    try:
        stop._enter(group, spark)
        context.setJobGroup(group, "wavelake", interruptOnCancel=True)
        watch = _Watch(spark, group, total, on_progress) if on_progress else None
        out = action()
        stop.check()
        well = True
        return out
    except AbortError:
        raise
    except Exception as e:
        if stop.aborted:
            raise AbortError(stop._reason) from e
        raise
    finally:
        stop._leave(group)
        for k, v in before.items():
            context.setLocalProperty(k, v)
        if watch:
            watch.end(well)
