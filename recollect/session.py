"""Sessions: settings that the engine counts on, and code for the workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; on a cluster, pass spark.checkpoint.dir, a folder that all executors share."""
    builder = SparkSession.builder.appName("recollect").config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return prepared((builder.master(master) if master else builder).getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it isn't installed: they get its folder on their path."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
