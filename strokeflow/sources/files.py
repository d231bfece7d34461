"""Readers and writers for the engine's text formats: schema first, bad rows to nulls, never an inferred schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import loose_boolean

TRACK_CSV = "source_frame string, timestamp_seconds string, detected string, class_name string, confidence string, x_center string, y_center string, width string, height string"
REQUIRED = ("source_frame", "timestamp_seconds", "detected", "x_center", "y_center")
LABEL_TYPES = ("wall", "side_wall", "floor", "racket")


def read_track_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ball-track CSV files (a run per file) with a header; fails if a required column is missing."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    num = lambda c, t="double": F.expr(f"try_cast({c} AS {t})")
    rows = raw.withColumn("run_id", F.input_file_name()).withColumn("seq", F.monotonically_increasing_id())
    return rows.select("run_id", "seq", num("source_frame", "bigint").alias("frame"), num("timestamp_seconds").alias("t"), loose_boolean(F.col("detected")).alias("detected"), num("x_center").alias("x"), num("y_center").alias("y"))


def kept_positions(rows: DataFrame) -> DataFrame:
    """Detected rows with a position that differs from the one before (of the detected)."""
    w = Window.partitionBy("run_id").orderBy("seq")
    seen = rows.filter("detected AND x IS NOT NULL AND y IS NOT NULL").withColumn("_p", F.lag(F.struct("x", "y")).over(w))
    return seen.filter(F.col("_p").isNull() | (F.col("_p") != F.struct("x", "y"))).drop("_p")


def last_per_frame(rows: DataFrame) -> DataFrame:
    """The last row of a frame wins; undetected ones have no position and no size."""
    w = Window.partitionBy("run_id", "frame").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def normal_labels(rows: DataFrame) -> DataFrame:
    """Labels (run_id, seq, frame, type): aliases, wall by default, unknown types and frames skipped, last wins."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("wall"))))
    kind = F.when(kind == "sidewall", "side_wall").when(kind == "", "wall").otherwise(kind)
    good = rows.withColumn("type", kind).withColumn("frame", F.expr("try_cast(frame AS bigint)")).filter(F.col("type").isin(*LABEL_TYPES) & F.col("frame").isNotNull())
    return last_per_frame(good)


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines (value); blank lines and // comments are skipped, malformed ones give nulls."""
    kept = lines.filter("trim(value) <> '' AND NOT ltrim(value) LIKE '//%'")
    return kept.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """:func:`json_lines` of files."""
    return json_lines(spark.read.text(path), schema)


def track_lines(rows: DataFrame) -> DataFrame:
    """The fields of a track's lines as text: fixed decimals, rounded half to even, and blanks where undetected."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.bround(c, n))
    seen = lambda c: F.when(F.col("detected"), fixed(c, 3)).otherwise("")
    return rows.select("run_id", "frame", fixed("t", 6).alias("t"), F.col("detected").cast("string").alias("detected"), seen("x").alias("x"), seen("y").alias("y"))


def write_track_csv(rows: DataFrame, path: str) -> None:
    """:func:`track_lines`, sorted within runs, with a header."""
    out = track_lines(rows).repartition("run_id").sortWithinPartitions("run_id", "frame")
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces ``old`` by key; rows of ``new`` with a null payload delete."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.filter("payload IS NOT NULL"))
