"""Temporal and interval joins.

The run is always an equi-key, and time is cut into buckets as wide as the
tolerance, so a band join is a hash join on (run, bucket) over at most two or
three buckets a row rather than a nested loop over a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id"]


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: float, how: str = "inner") -> DataFrame:
    """Rows of both sides, of one run, whose times differ by ``tolerance`` at most. Right columns other than the run must have other names."""
    bucket = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    spread = left.withColumn("_b", F.explode(F.sequence(bucket(left_at) - 1, bucket(left_at) + 1)))
    other = right.withColumn("_b", bucket(right_at))
    return spread.join(other, [*KEY, "_b"], how).filter(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance).drop("_b")


def nearest(left: DataFrame, right: DataFrame, left_at: str, right_at: str, tolerance: float, left_id: str, right_order: str) -> DataFrame:
    """Each left row with the nearest right row within ``tolerance``, the first by ``right_order`` on a tie, or nulls."""
    near = band_join(left.select(*KEY, left_id, left_at), right, left_at, right_at, tolerance)
    w = Window.partitionBy(*KEY, left_id).orderBy(F.abs(F.col(left_at) - F.col(right_at)), right_order)
    best = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", left_at)
    return left.join(best, [*KEY, left_id], "left")


def backward_asof(left: DataFrame, right: DataFrame, left_at: str, right_at: str, lookback: float, left_id: str) -> DataFrame:
    """The last right row in [t - lookback, t), or nulls."""
    near = band_join(left.select(*KEY, left_id, left_at), right, left_at, right_at, lookback).filter(F.col(right_at) < F.col(left_at))
    w = Window.partitionBy(*KEY, left_id).orderBy(F.desc(right_at), F.desc("right_seq"))
    best = near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", left_at)
    return left.join(best, [*KEY, left_id], "left")


def _interval_candidates(points: DataFrame, intervals: DataFrame, at: str, width: float) -> DataFrame:
    """Points with intervals of their run that hold them (closed); an interval is listed under each bucket that it meets."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.filter("start <= end").withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("end"))))
    return points.withColumn("_b", bucket(at)).join(spread, [*KEY, "_b"]).filter(F.col(at).between(F.col("start"), F.col("end"))).drop("_b")


def first_interval(points: DataFrame, intervals: DataFrame, at: str, point_id: list[str], width: float = 16.0) -> DataFrame:
    """Each point with the first interval (by start, end) that holds it; points in none are dropped."""
    w = Window.partitionBy(*KEY, *point_id).orderBy("start", "end")
    return _interval_candidates(points, intervals, at, width).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_any_interval(points: DataFrame, intervals: DataFrame, at: str, width: float = 16.0) -> DataFrame:
    """Points that lie in some interval."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.filter("start <= end").withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("end")))).withColumnRenamed("run_id", "_run")
    p = points.withColumn("_pb", bucket(at))
    on = (F.col("run_id") == F.col("_run")) & (F.col("_pb") == F.col("_b")) & F.col(at).between(F.col("start"), F.col("end"))
    return p.join(spread, on, "left_semi").drop("_pb")


def rally_lookup(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """A point's own key, else the interval by time, else by frame."""
    by = lambda at, start, end, name: first_interval(
        points.filter(F.col(key).isNull()), intervals.select(*KEY, F.col(start).alias("start"), F.col(end).alias("end"), F.col("rally_number").alias(name)), at, ["frame"]
    ).select(*KEY, "frame", name)
    timed = points.join(by("t", "start_t", "end_t", "_by_time"), [*KEY, "frame"], "left").join(by("frame", "start_frame", "end_frame", "_by_frame"), [*KEY, "frame"], "left")
    return timed.withColumn("rally_found", F.coalesce(key, "_by_time", "_by_frame")).drop("_by_time", "_by_frame")


def overlapping(a: DataFrame, b: DataFrame, width: float = 16.0) -> DataFrame:
    """Intervals of ``a`` stretched to the hull with the intervals of ``b`` that overlap them.

    Both sides are listed under each bucket that they meet; a pair counts in
    the first bucket that both meet.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    under = lambda df, s, e: df.withColumn("_b", F.explode(F.sequence(bucket(s), bucket(e))))
    other = under(b.select(*KEY, F.col("start").alias("_s"), F.col("end").alias("_e")).filter("_s <= _e"), "_s", "_e")
    met = under(a.filter("start <= end"), "start", "end").join(other, [*KEY, "_b"])
    met = met.filter((F.col("start") <= F.col("_e")) & (F.col("_s") <= F.col("end")) & (F.col("_b") == F.greatest(bucket("start"), bucket("_s"))))
    return met.groupBy(*KEY, "start", "end").agg(F.least("start", F.min("_s")).alias("hull_start"), F.greatest("end", F.max("_e")).alias("hull_end"), F.count("*").alias("n"))


def unclaimed(right: DataFrame, left: DataFrame, right_at: str, left_at: str, tolerance: float, right_id: str) -> DataFrame:
    """Right rows without any left row within ``tolerance``."""
    claimed = band_join(left.select(*KEY, left_at), right.select(*KEY, right_at, right_id), left_at, right_at, tolerance).select(*KEY, right_id).distinct()
    return right.join(claimed, [*KEY, right_id], "left_anti")


def greedy_match(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """One to one, in the order of left ``at``: each takes the nearest right ``at`` that is free and within ``tolerance``, the earlier on a tie.

    A claim bars later ones, so this is a fold over the two lists of one run.
    """
    l = left.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("l"))
    r = right.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("r"))
    both = l.join(r, KEY, "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<at:double,id:bigint>>")))

    def best(acc: Column, x: Column) -> Column:
        free = F.filter("r", lambda y: (F.abs(y["at"] - x["at"]) <= tolerance) & ~F.array_contains(acc["used"], y["id"]))
        return F.array_min(F.transform(free, lambda y: F.struct(F.abs(y["at"] - x["at"]).alias("d"), y["at"].alias("at"), y["id"].alias("id"))))

    def step(acc: Column, x: Column) -> Column:
        def claim(b: Column) -> Column:
            row = F.struct(x["id"].alias("left_id"), b["id"].alias("right_id"), b["d"].alias("distance"))
            return F.struct(
                F.when(b.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(b["id"]))).alias("used"), F.concat(acc["out"], F.array(row)).alias("out")
            )

        return F.get(F.transform(F.array(best(acc, x)), claim), F.lit(0))

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<left_id:bigint,right_id:bigint,distance:double>>").alias("out"))
    return both.select(*KEY, F.inline(F.aggregate("l", start, step)["out"]))


def dense(df: DataFrame, lattice: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Every combination of the runs' keys and the lattice, with zeros where ``df`` has no row. The lattice is a fixed list of a few rows."""
    names = [c for c in lattice.columns]
    full = df.select(*keys).distinct().crossJoin(F.broadcast(lattice))
    return full.join(df, [*keys, *names], "left").fillna(0, counts)


def neighbours_wrapped(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """The next and the previous label of a frame, strict, wrapping around; the frame itself where a run has none.

    Labels and frames stand in one order, so one sort by run replaces the join.
    """
    frame = F.col("frame").cast("long").alias("frame")
    both = frames.select(*KEY, frame, F.lit(None).cast("long").alias("_label")).unionByName(labels.select(*KEY, frame, frame.alias("_label")).distinct())
    w, run = Window.partitionBy(*KEY).orderBy("frame"), Window.partitionBy(*KEY)
    ahead = F.min("_label").over(w.rangeBetween(1, Window.unboundedFollowing))
    behind = F.max("_label").over(w.rangeBetween(Window.unboundedPreceding, -1))
    rows = both.withColumns({"next_label": F.coalesce(ahead, F.min("_label").over(run), "frame"), "previous_label": F.coalesce(behind, F.max("_label").over(run), "frame")})
    return rows.filter("_label IS NULL").drop("_label")
