"""Streaming forms: fixed-gap sessions with a watermark, and first-wins dedup.

The adaptive gap needs a whole run, so streams use its default.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, gap: str = "5 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user's events (user_id, ts) that close after ``gap``; state ends with the watermark."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def run_to_end(events: DataFrame, whole: DataFrame, gap: str = "5 hours", late: str = "1 day") -> DataFrame:
    """S1 over a bounded stream: its closed sessions, written as Parquet to the shared folder, and those that the watermark leaves open at the end, in batch form from ``whole``, the same rows."""
    spark = events.sparkSession
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="strokeflow-") if found.isEmpty() else found.get())
    path = f"{top}/sessions-{uuid.uuid4().hex}"
    closed = stream_sessions(events, gap, late)
    q = closed.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    q.awaitTermination()
    done = spark.read.schema(closed.schema).parquet(path)
    # A little further back than the last watermark; what the stream has closed itself goes by the join.
    mark = whole.agg((F.max("ts") - F.expr(f"INTERVAL {late}") - F.expr("INTERVAL 1 minute")).alias("mark"))
    every = whole.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    tail = every.join(F.broadcast(mark), F.col("w.end") > F.col("mark")).select("user_id", F.col("w.start").alias("start"), "n")
    same = tail["user_id"].eqNullSafe(done["user_id"]) & (tail["start"] == done["start"])
    return done.unionByName(tail.join(done, same, "left_anti"))


def stream_first(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """S3: the first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
