"""Aggregations: zone histograms, shot and rally metrics, movement, robust thresholds, evaluation.

Conditional aggregates need one pass; levels of detail (match, player, player
and outcome) are grouping sets over one input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

KEY = ["run_id"]


def rate(condition: Column) -> Column:
    """Percentage of rows, null conditions counting as no."""
    return F.round(F.sum(F.when(condition, 1).otherwise(0)) * 100.0 / F.count("*"), 1)


def zone_summary(zoned: DataFrame, zones: int, keys: list[str], top: int = 3) -> DataFrame:
    """Per key a dense histogram of ``zone`` 1..zones: count, share of all, rank among non-empty zones up to ``top``."""
    counts = zoned.groupBy(*keys, "zone").agg(F.count("*").alias("n"))
    lattice = counts.sparkSession.range(1, zones + 1).select(F.col("id").cast("int").alias("zone"))
    full = counts.select(*keys).distinct().crossJoin(F.broadcast(lattice)).join(counts, [*keys, "zone"], "left").fillna(0, ["n"])
    everything = Window.partitionBy(*keys)
    place = F.row_number().over(everything.orderBy(F.desc("n"), "zone"))
    return full.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(everything), 1)).withColumn("top", F.when((F.col("n") > 0) & (place <= top), place))


def shot_metrics(digits: int = 1) -> list[Column]:
    """Aggregates over hits with x, y, call, speeds, rounded to ``digits``."""
    height = C.wall_height_ft(F.col("y"))
    return [
        F.count("*").alias("shots"), F.round(F.avg(height), digits).alias("avg_height_ft"), F.round(F.avg("speed_before"), digits).alias("avg_speed_in"),
        F.round(F.avg("speed_after"), digits).alias("avg_speed_out"), F.round(F.max("speed_before"), digits).alias("max_speed"),
        rate(F.col("x").between(C.CENTER_LEFT, C.CENTER_RIGHT)).alias("centre_pct"), rate(~F.col("x").between(C.CENTER_LEFT, C.CENTER_RIGHT)).alias("side_pct"),
        F.count_if(F.col("call") == "IN").alias("n_in"), F.count_if(F.col("call") == "OUT").alias("n_out"),
    ]


def coaching(hits_with_players: DataFrame, digits: int = 1) -> DataFrame:
    """Shot metrics by run, by player and by player and outcome, from one input."""
    view = hits_with_players.select("run_id", "player", "outcome", "x", "y", "call", "speed_before", "speed_after")
    levels = [["run_id"], ["run_id", "player"], ["run_id", "player", "outcome"]]
    return view.groupingSets([[F.col(c) for c in level] for level in levels], "run_id", "player", "outcome").agg(F.grouping_id().alias("level"), *shot_metrics(digits))


def last_hits(hits: DataFrame) -> DataFrame:
    """The last hit of each rally by time and frame, the later row on a tie."""
    return hits.groupBy(*KEY, "rally_number").agg(F.max_by(F.struct("frame", "event_type", "call"), F.struct("t", "frame", "event_id")).alias("last"))


def error_metrics(rallies: DataFrame, player: Column) -> list[Column]:
    """Of the rallies a player lost, unforced and forced; mean length of those it won."""
    lost = F.col("winner") == 3 - player
    unforced = lost & (F.col("winner_reason").isin("serve_out", "last_out"))
    return [
        F.count_if(lost).alias("lost"), F.count_if(unforced).alias("unforced"), F.count_if(lost & ~F.col("winner_reason").isin("serve_out", "last_out")).alias("forced"),
        F.round(F.try_divide(F.count_if(unforced) * 100.0, F.count_if(lost)), 1).alias("unforced_pct"),
        F.round(F.avg(F.when(F.col("winner") == player, F.col("end_t") - F.col("start_t"))), 6).alias("avg_won_length"),
    ]


def movement(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Distance with clamped speed, mean and p95 speed, share near the T and in front, coverage."""
    w = Window.partitionBy(*keys).orderBy("t")
    dt = F.col("t") - F.lag("t").over(w)
    step = F.hypot(F.col("x_ft") - F.lag("x_ft").over(w), F.col("y_ft") - F.lag("y_ft").over(w))
    rows = samples.withColumn("dt", F.when(dt > 0, dt)).withColumn(
        "speed", F.when(F.col("dt").isNotNull(), F.least(F.lit(C.SPEED_MAX_FTPS), step / F.col("dt")))
    )
    near = F.hypot(F.col("x_ft") - C.COURT_WIDTH_FT / 2, F.col("y_ft") - 18.0) <= 6.0
    speeds = F.array_sort(F.collect_list("speed"))
    return rows.groupBy(*keys).agg(
        F.round(F.coalesce(F.sum(F.col("speed") * F.col("dt")), F.lit(0.0)), 4).alias("distance_ft"), F.round(F.avg("speed"), 6).alias("avg_speed"),
        F.round(C.nearest_rank(speeds, 0.95), 6).alias("p95_speed"), rate(near).alias("t_pct"), rate(F.col("y_ft") < 16.0).alias("front_pct"),
        F.round(F.sum(F.when(F.col("dt") <= 0.5, F.col("dt")).otherwise(0)) / F.when(F.max("t") > F.min("t"), F.max("t") - F.min("t")), 6).alias("coverage"),
    )


def heatmap(samples: DataFrame, keys: list[str], columns: int = 7, rows: int = 8) -> DataFrame:
    """Share of samples in each cell of the court."""
    cells = samples.groupBy(*keys, C.grid_cell(F.col("x_ft"), C.COURT_WIDTH_FT, columns).alias("cx"), C.grid_cell(F.col("y_ft"), C.COURT_LENGTH_FT, rows).alias("cy")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def robust_threshold(series: DataFrame, keys: list[str], value: str, k: float = 3.0) -> DataFrame:
    """Median + k MAD; without spread, halfway from the median to p95; null if that does not exceed the median."""
    first = series.groupBy(*keys).agg(F.median(value).alias("median"), F.array_sort(F.collect_list(value)).alias("_v"))
    mad = series.join(first.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    p95 = C.nearest_rank(F.col("_v"), 0.95)
    low = F.when(p95 > F.col("median"), F.col("median") + (p95 - F.col("median")) / 2)
    return first.join(mad, keys).select(*keys, "median", "mad", F.when(F.col("mad") > 0, F.col("median") + k * F.col("mad")).otherwise(low).alias("threshold"))


def ambiguity_confidence(rallies: DataFrame, moments: DataFrame) -> DataFrame:
    """1 less the ambiguous moments in (previous end, start] of each rally, 0 at least; null for the first.

    Moments and the rallies' borders stand in one order of time; a running
    count at both borders of a pause gives the moments within it.
    """
    w = Window.partitionBy(*KEY).orderBy("rally_number")
    spans = rallies.select(*KEY, "rally_number", "start_t", F.lag("end_t").over(w).alias("_prev"))
    none = F.lit(None).cast("long")
    marks = [spans.select(*KEY, F.col(at).alias("at"), F.col("rally_number").cast("long").alias("_rally"), F.lit(sign).alias("_sign"), F.lit(0).alias("_one")) for at, sign in (("start_t", 1), ("_prev", -1))]
    points = marks[0].unionByName(marks[1].filter("at IS NOT NULL")).unionByName(moments.select(*KEY, "at", none.alias("_rally"), F.lit(0).alias("_sign"), F.lit(1).alias("_one")))
    upto = F.sum("_one").over(Window.partitionBy(*KEY).orderBy("at"))  # moments at the same time included
    counted = points.withColumn("_upto", upto).filter("_rally IS NOT NULL").groupBy(*KEY, F.col("_rally").alias("rally_number"))
    met = counted.agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_n"), F.count_if(F.col("_sign") < 0).alias("_paused"))
    return met.select(*KEY, "rally_number", F.when(F.col("_paused") > 0, F.greatest(F.lit(0), 1 - F.col("_n"))).cast("double").alias("confidence"))


def binary_metrics(truth: Column, predicted: Column) -> list[Column]:
    """Confusion counts, precision, recall, F1, F2, accuracy; 0 where a denominator is."""
    tp, fp = F.count_if(truth & predicted), F.count_if(~truth & predicted)
    fn, tn = F.count_if(truth & ~predicted), F.count_if(~truth & ~predicted)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    ]


def best_of_group(rows: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    """Per group the best member (the first on a tie) and the members in order."""
    return rows.groupBy(*keys).agg(
        F.max(F.struct(F.col(score), -F.col(seq))).alias("_b"), F.array_sort(F.collect_list(seq)).alias("members")
    ).select(*keys, F.col(f"_b.{score}").alias("best"), (-F.col("_b.col2")).alias("best_seq"), "members")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """N / (classes n_class) for every row."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    stats = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    per = n.crossJoin(stats).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(per), label)
