"""Progress, cancellation and memory of running work, by Spark's own means (K10, R2, R5)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import SparkSession

log = logging.getLogger("lattica")


@contextmanager
def step(spark: SparkSession, name: str, group: str = "lattica") -> Iterator[None]:
    """Jobs started inside carry the name and belong to the group; begin and end are logged."""
    spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
    log.info("%s: begins", name)
    try:
        yield
    finally:
        log.info("%s: ends", name)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def cancel(spark: SparkSession, group: str = "lattica") -> None:
    """Stop the group's jobs; what runs them gets an error."""
    spark.sparkContext.cancelJobGroup(group)


def progress(spark: SparkSession, group: str = "lattica") -> tuple[int, int]:
    """Tasks done and tasks in all of the group's active stages."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


def in_background(spark: SparkSession, work: Callable[[], None], group: str = "lattica") -> InheritableThread:
    """The work in a thread whose jobs belong to the group, so that it can be watched and cancelled."""

    def run() -> None:
        with step(spark, "background", group):
            work()

    thread = InheritableThread(run, session=spark)
    thread.start()
    return thread


def memory(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Bytes that each executor has for storage, and how many of them are free."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    out, it = {}, status.iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = (pair._2()._1(), pair._2()._2())
    return out
