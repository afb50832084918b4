"""A Spark session with the settings that the plans expect."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session writes what it cuts lineage by, if it names no folder.
LOCAL = "file:///tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []


def session(name: str = "lexigraf", **conf: str) -> SparkSession:
    """AQE on, skewed joins split, UTC; the master and all sizes stay with the launcher."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if "spark.master" not in settings and "SPARK_MASTER" in os.environ:
        settings["spark.master"] = os.environ["SPARK_MASTER"]
    return builder.config(map=settings).getOrCreate()


def spread(frame: DataFrame) -> DataFrame:
    """The frame over as many tasks as the cluster runs at once, if its input comes in fewer (one file with one row group,
    say).  Large inputs come in more and pass untouched, so nothing large is shuffled for this."""
    wanted = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{(root or LOCAL).rstrip('/')}/lexigraf-{spark.sparkContext.applicationId}"


def stored(frame: DataFrame, tag: str = "step") -> DataFrame:
    """The frame written to the shared folder and read again, so that plans end there and lost executors cost nothing."""
    spark, path = frame.sparkSession, f"{shared_folder(frame.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    _written.append((spark, path))
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; its folder is then the cluster's to clean
            pass


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(frame: DataFrame) -> None:
    """Delete what ``stored`` wrote for a frame that nothing reads any more."""
    _delete(frame.sparkSession, frame.stored_at)
    _written.remove((frame.sparkSession, frame.stored_at))
