"""How far a Spark action is, told while it runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


def with_progress(spark: SparkSession, action: Callable[[], Any], total: int, report: Callable[[int, int], None], every_s: float = 0.1) -> Any:
    """Run ``action`` (one or more Spark jobs) and return what it returns.

    ``report(done, total)`` is called with (0, total) first, then whenever the share
    of tasks done has grown, and with (total, total) at the end.  The action runs
    in a thread under a job group of its own, and this thread asks the status
    tracker; stages that Spark has not planned yet are not known, so the share is
    never taken back when they come.
    """
    group, out = f"progress-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "told while it runs")
        try:
            out["value"] = action()
        except BaseException as e:  # raised again in the caller's thread
            out["error"] = e

    tracker, done = spark.sparkContext.statusTracker(), 0
    report(0, total)
    thread = InheritableThread(target=run, session=spark)
    thread.start()
    while thread.is_alive():
        thread.join(every_s)
        tasks, finished = 0, 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s is not None:
                    tasks, finished = tasks + s.numTasks, finished + s.numCompletedTasks
        share = min(total - 1, total * finished // tasks) if tasks else 0
        if share > done:
            done = share
            report(done, total)
    if "error" in out:
        raise out["error"]
    report(total, total)
    return out["value"]


def timed(report: Callable[[int, int, float], None]) -> Callable[[int, int], None]:
    """A report with the seconds since the first call."""
    began = time.monotonic()
    return lambda done, total: report(done, total, time.monotonic() - began)
