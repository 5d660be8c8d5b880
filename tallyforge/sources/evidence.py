"""What Spark did for a piece of work: its jobs, stages, tasks and failures, from the status store by job tag."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_STAGE = {
    "tasks": "numTasks", "failed_tasks": "numFailedTasks", "input_records": "inputRecords", "output_records": "outputRecords",
    "shuffle_read_records": "shuffleReadRecords", "shuffle_write_records": "shuffleWriteRecords", "shuffle_write_bytes": "shuffleWriteBytes", "spilled_bytes": "diskBytesSpilled",
}


@contextmanager
def recorded(spark: SparkSession, what: str) -> Iterator[dict]:
    """Fills the dict it gives when the block ends, also by an error: application, tag, jobs, stages, totals, failed_jobs.

    Jobs are those that this thread starts. Spark keeps the last spark.ui.retainedJobs jobs and as many stages; jobs that
    were started but are no longer kept are counted in `forgotten_jobs`, so that evidence is never silently short.
    """
    context, tag, found = spark.sparkContext, f"{what}-{uuid.uuid4().hex[:12]}", {}
    context.addJobTag(tag)
    try:
        yield found
    finally:
        context.removeJobTag(tag)
        found.update(_collected(spark, tag))


def _collected(spark: SparkSession, tag: str) -> dict:
    core = spark.sparkContext._jsc.sc()
    core.listenerBus().waitUntilEmpty(60_000)
    store, ids = core.statusStore(), sorted(core.statusTracker().getJobIdsForTag(tag))
    jobs, stages, forgotten = [], {}, 0
    for i in ids:
        try:
            job = store.job(i)
        except Exception:  # no longer kept
            forgotten += 1
            continue
        numbers = job.stageIds()
        mine = [numbers.apply(n) for n in range(numbers.size())]
        jobs.append({"job": i, "status": job.status().toString(), "stages": sorted(mine), "tasks": job.numTasks(), "failed_tasks": job.numFailedTasks()})
        for s in mine:
            if s not in stages:
                stages[s] = _stage(store, s)
    done = [s for s in stages.values() if s is not None]
    totals = {name: sum(s[name] for s in done) for name in _STAGE}
    return {
        "application": spark.sparkContext.applicationId, "tag": tag, "spark": spark.version, "jobs": jobs, "stages": done, "totals": totals | {"jobs": len(jobs), "stages": len(done)},
        "failed_jobs": [j["job"] for j in jobs if j["status"] != "SUCCEEDED"], "forgotten_jobs": forgotten,
    }


def _stage(store, number: int) -> dict | None:
    """The stage's last attempt; None for one that was skipped, as its output was there, or is no longer kept."""
    try:
        data = store.lastStageAttempt(number)
    except Exception:
        return None
    status = data.status().toString()
    if status == "SKIPPED":
        return None
    return {"stage": number, "attempt": data.attemptId(), "status": status} | {name: getattr(data, field)() for name, field in _STAGE.items()}


def sound(found: dict) -> bool:
    """Evidence of work that is all there and of which no job failed."""
    return bool(found.get("jobs")) and not found.get("failed_jobs") and not found.get("forgotten_jobs")
