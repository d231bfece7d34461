"""Queries over streams (S), run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..streaming.sessions import run_to_end


@register("s1_stream_sessions")
def s1(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = spark.read.schema(schema).parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_end(events, whole)
