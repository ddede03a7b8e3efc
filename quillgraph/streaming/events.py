"""Event streams: windows, sessions and de-duplication with watermarks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream; the schema is that of the files there now."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """``ts`` as a timestamp with a watermark; without ``late`` an earlier watermark stays."""
    if dict(events.dtypes)["ts"] != "timestamp":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events if late is None else events.withWatermark("ts", late)


def windowed_counts(events: DataFrame, late: str | None = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and values by window and type; works on streams and tables."""
    out = _timed(events, late).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str | None = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder for checkpoints that all executors share: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/quillgraph-streams"
    return top.rstrip("/")


def streamed(events: DataFrame, build, checkpoint: str, mode: str = "complete") -> DataFrame:
    """``build`` of an event stream, run over all that is there; the result as a table."""
    name = f"streamed_{uuid.uuid4().hex}"
    return run_once(build(events), name, f"{checkpoint.rstrip('/')}/{name}", mode)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all that is there into an in-memory table and return it; for results that fit the driver."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
