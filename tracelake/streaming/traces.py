"""A stream of traces from JSON lines, and what is read off it by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A message: {"type": "Trace", "process", "case_id", "seq", "sent", "events": [{"name", "timestamp"}]}; other types are passed over.
MESSAGE = "type string, process string, case_id string, seq long, sent timestamp, events array<struct<name:string,timestamp:string>>"


def trace_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(key, case_id, seq, sent, acts) of the Trace messages in a folder that files are added to. ``seq`` orders a process's messages.

    The number of files bounds a trigger. What has been read is kept in the query's checkpoint folder.
    """
    rows = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("type = 'Trace' and process is not null and case_id is not null").select(F.col("process").alias("key"), "case_id", "seq", "sent", F.transform(F.coalesce("events", F.array().cast("array<struct<name:string,timestamp:string>>")), lambda e: e["name"]).alias("acts"))


def arrival_rate(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, start, traces): traces by process and window of their sending time; those later than ``late`` are left out."""
    rows = stream.withWatermark("sent", late).groupBy("key", F.window("sent", width).alias("window")).agg(F.count("*").alias("traces"))
    return rows.select("key", F.col("window.start").alias("start"), "traces")
