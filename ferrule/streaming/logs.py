"""Log events as a stream: files to events, windowed counts with a watermark, sessions by thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.logs import is_header, stamp, thread


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Header lines of a folder of logs, as they arrive: (path, ts, thread, header). Body lines need the file as a whole."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    path = F.col("_metadata.file_path")
    return rows.where(is_header(F.col("value"))).select(path.alias("path"), stamp(F.col("value")).cast("timestamp").alias("ts"), thread(F.col("value")).alias("thread"), F.col("value").alias("header"))


def counts(events: DataFrame, group: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by group and window of time; those later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), group).count().select(F.col("window.start").alias("start"), group, F.col("count").alias("n"))


def thread_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each thread: events without a pause longer than ``gap``."""
    return events.withWatermark("ts", late).groupBy("thread", F.session_window("ts", gap)).count().select("thread", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))
