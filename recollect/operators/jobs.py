"""The log of maintenance jobs: rows of the table maintenance_jobs, and what resumes them."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..schemas import TABLES

PHASES = ("decay", "tidy", "govern")


def first_checkpoint(phase: str) -> dict:
    return {"requestedPhase": phase, "nextPhase": PHASES[0] if phase == "all" else phase, "completedPhases": [], "phaseResults": {}}


def created(spark: SparkSession, job_id: str, phase: str, now: datetime | str, checkpoint: dict | None = None) -> DataFrame:
    """The row of a new job, running."""
    told = json.dumps(checkpoint or first_checkpoint(phase))
    return spark.range(1).select(*[c.cast(TABLES["maintenance_jobs"][n].dataType).alias(n) for n, c in {"job_id": F.lit(job_id), "phase": F.lit(phase), "status": F.lit("running"), "checkpoint": F.lit(told), "error": F.lit(None), "started_at": scores.instant(now), "finished_at": F.lit(None)}.items()])


def changed(jobs: DataFrame, job_id: str, status: str, checkpoint: dict | None = None, error: str | None = None, now: datetime | str | None = None) -> DataFrame:
    """jobs with one of them running, failed or completed; without a new checkpoint the old one stays, and only ended jobs have an end."""
    own = F.col("job_id") == job_id
    new = {"status": F.lit(status), "error": F.lit(error).cast("string"), "finished_at": scores.instant(now) if status != "running" else F.lit(None).cast("timestamp")}
    new |= {"checkpoint": F.lit(json.dumps(checkpoint))} if checkpoint is not None else {}
    return jobs.withColumns({n: F.when(own, c).otherwise(F.col(n)) for n, c in new.items()})


def resumable(jobs: DataFrame, phase: str) -> DataFrame:
    """The latest job of a phase that runs or failed, if any."""
    return jobs.filter((F.col("phase") == phase) & F.col("status").isin("running", "failed")).orderBy(F.desc("started_at"), "job_id").limit(1)


def latest(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(limit)


def checkpoint_of(told: str | None) -> dict | None:
    """A checkpoint from its JSON; None where it can't be read."""
    try:
        return json.loads(told) if told else None
    except ValueError:
        return None
