"""Streams: commits that arrive, and scores over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import git
from ..sources.store import VersionedStore


def index_stream(spark: SparkSession, folder: str, store: VersionedStore, checkpoint: str):
    """Index the commits named in JSON files (ref) that arrive in ``folder``, ancestors first in each batch.  Indexing a
    commit again changes nothing, so a batch that is repeated after a failure is safe."""

    def take(batch: DataFrame, _: int) -> None:
        refs = [store.resolve(r[0]) for r in batch.select("ref").distinct().collect()]  # commits of one batch
        for commit in git.oldest_first(store.repo, refs):
            store.index_commit(commit)

    rows = spark.readStream.schema("ref string").json(folder)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and type of a stream (ts, event_type, value): count, mean and most; what comes later than ``late`` is dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    grouped = stamped.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(
        F.col("window.start").alias("start"), "event_type", "n", "mean", "most"
    )
