"""Structured Streaming: files to memories, and passive feedback with a limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.feedback import PASSIVE_MOST, WINDOW_MICROS
from ..sources import markdown


def watched(spark: SparkSession, folder: str, journals: bool = False) -> DataFrame:
    """A stream of (file, text, at) of the markdown files in a folder; daily journals only if asked for."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    files = rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("at"))
    return files if journals else files.filter(~F.col("file").rlike(r"^\d{4}-\d{2}-\d{2}\.md$"))


def ingest(files: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Runs write(items, batch) for each batch of a stream of files, one batch at a time.

    Of a file that changed several times within a batch the latest counts; the trigger's interval is what
    gathers quick changes.
    """

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("file").agg(F.max_by("text", "at").alias("text"))
        write(markdown.items(latest, F.col("file")), number)

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=every)).start()


def admitted(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Of one memory's attempts those accepted; the state is the last accepted times, three at most."""
    kept = list(state.get[0]) if state.exists else []
    out = []
    for t in sorted(t for chunk in chunks for t in chunk["at_us"].tolist()):
        kept = [x for x in kept if x > t - WINDOW_MICROS]
        if len(kept) < PASSIVE_MOST:
            kept.append(t)
            out.append(t)
    state.update((kept[-PASSIVE_MOST:],))
    yield pd.DataFrame({"memory_id": [key[0]] * len(out), "at_us": pd.Series(out, dtype="int64")})


def limit_passive(attempts: DataFrame) -> DataFrame:
    """The accepted of a stream of attempts (memory_id, created_at), no more than three in 24 hours each."""
    keyed = attempts.select(F.col("memory_id").cast("long").alias("memory_id"), F.unix_micros("created_at").alias("at_us"))
    return keyed.groupBy("memory_id").applyInPandasWithState(admitted, "memory_id long, at_us long", "times array<long>", "append", "NoTimeout")


def rollup(events: DataFrame, lateness: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(start, source, n, value) of a stream of feedback by event time; events later than `lateness` are left out."""
    grouped = events.withWatermark("created_at", lateness).groupBy(F.window("created_at", window).alias("w"), "source")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "source", "n", "value")
