"""Set operations, dedup, deterministic sampling, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key, the first of ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def largest_session(rows: DataFrame, key: str, session: str) -> DataFrame:
    """Per key all rows of the session with most rows, the larger id on a tie."""
    sizes = rows.groupBy(key, session).agg(F.count("*").alias("_n"))
    best = sizes.groupBy(key).agg(F.max(F.struct("_n", session)).alias("_b")).select(key, F.col(f"_b.{session}").alias(session))
    return rows.join(best, [key, session], "left_semi")


def dilate(labels: DataFrame, k: int, low: int | Column, high: int | Column) -> DataFrame:
    """Frames within ``k`` of a label, clipped, once each."""
    return labels.select("run_id", F.explode(F.sequence(F.greatest(F.col("frame") - k, F.lit(low)), F.least(F.col("frame") + k, F.lit(high)))).alias("frame")).distinct()


def negatives(frames: DataFrame, labels: DataFrame, exclusion: int, per_run: int, seed: str = "negatives") -> DataFrame:
    """``per_run`` frames away from labels, in the order of a seeded hash."""
    far = frames.join(dilate(labels, exclusion, 0, 1 << 40), ["run_id", "frame"], "left_anti")
    order = F.md5(F.concat_ws("-", F.lit(seed), "run_id", "frame"))
    return far.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy(order))).filter(F.col("_n") <= per_run).drop("_n")


def stratified_split(rows: DataFrame, label: str, id_: str, test_share: float, seed: str = "split") -> DataFrame:
    """Of each class the first ``test_share`` in the order of a seeded hash is the test set."""
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(id_)))
    w = Window.partitionBy(label)
    place = F.row_number().over(w.orderBy(order, id_))
    return rows.withColumn("is_test", place <= F.round(F.count("*").over(w) * test_share))


def top_n(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
