"""Windows over trajectories: smoothing, differences, context, gaps, fits, valleys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id"]


def by_frame(*more: str):
    return Window.partitionBy(*KEY, *more).orderBy("frame")


def smooth_rows(df: DataFrame, value: str, window: int, name: str) -> DataFrame:
    """centred mean over rows with replicated edges; shorter runs are left alone."""
    before, after = window // 2, window - 1 - window // 2
    w, everything = by_frame(), Window.partitionBy(*KEY)
    n, at = F.count("*").over(everything), F.row_number().over(w)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    missing_left, missing_right = F.greatest(F.lit(0), before - (at - 1)), F.greatest(F.lit(0), after - (n - at))
    mean = (F.sum(value).over(w.rowsBetween(-before, after)) + first * missing_left + last * missing_right) / window
    return df.withColumn(name, F.when(n >= window, mean).otherwise(F.col(value)))


def smooth_time(df: DataFrame, value: str, half: float, keys: list[str], name: str) -> DataFrame:
    """centred mean over a time range."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY t RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return df.withColumn(name, F.expr(f"avg({value}) {over}"))


def kinematics(df: DataFrame, track: str = "track_no") -> DataFrame:
    """velocity before and after each sample of a track, change of velocity, turn in degrees."""
    w = by_frame(track)
    d = lambda c, lead: (F.lead(c).over(w) - F.col(c)) / (F.lead("t").over(w) - F.col("t")) if lead else (F.col(c) - F.lag(c).over(w)) / (F.col("t") - F.lag("t").over(w))
    rows = df.withColumns({"vx0": d("x", False), "vy0": d("y", False), "vx1": d("x", True), "vy1": d("y", True)})
    speed = F.hypot("vx0", "vy0") * F.hypot("vx1", "vy1")
    cosine = F.try_divide(F.col("vx0") * F.col("vx1") + F.col("vy0") * F.col("vy1"), F.when(speed > 0, speed))
    return rows.withColumn("dv", F.hypot(F.col("vx1") - F.col("vx0"), F.col("vy1") - F.col("vy0"))).withColumn(
        "turn", F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    )


def bridge_candidates(df: DataFrame, max_seconds: float = 0.5, track: str = "track_no") -> DataFrame:
    """last velocity of a track against the first of the next one, where the pause is short."""
    k = kinematics(df, track)
    ends = k.groupBy(*KEY, track).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min_by(F.struct("vx1", "vy1"), "frame").alias("v_in"), F.max_by(F.struct("vx0", "vy0"), "frame").alias("v_out"),
    )
    w = Window.partitionBy(*KEY).orderBy(track)
    rows = ends.withColumns({"prev_t": F.lag("last_t").over(w), "prev_v": F.lag("v_out").over(w), "prev_frame": F.lag("last_frame").over(w)})
    gap = F.col("first_t") - F.col("prev_t")
    dv = F.hypot(F.col("v_in.vx1") - F.col("prev_v.vx0"), F.col("v_in.vy1") - F.col("prev_v.vy0"))
    return rows.filter((gap > 0) & (gap <= max_seconds)).select(*KEY, "prev_frame", "first_frame", dv.alias("dv"))


def context(df: DataFrame, c: int, columns: list[str]) -> DataFrame:
    """values at frame offsets -c to c (0 where a frame is missing), span and mean over them. Offsets are of frames, not of rows."""
    names = {k: f"m{-k}" if k < 0 else f"p{k}" for k in range(-c, c + 1)}
    wide = df.select(*KEY, "frame", F.explode(F.sequence(F.lit(-c), F.lit(c))).alias("k"), *columns).select(*KEY, (F.col("frame") - F.col("k")).alias("frame"), "k", *columns)
    aggs: list[Column] = [F.coalesce(F.max(F.when(F.col("k") == k, F.col(col))), F.lit(0.0)).alias(f"{col}_{n}") for k, n in names.items() for col in columns]
    aggs += [f for col in columns for f in ((F.max(col) - F.min(col)).alias(f"{col}_span"), F.avg(col).alias(f"{col}_mean"))]
    return df.select(*KEY, "frame").join(wide.groupBy(*KEY, "frame").agg(*aggs), [*KEY, "frame"])


def neighbourhood(df: DataFrame, frames: int) -> DataFrame:
    """Count, span and path length of the samples within ``frames`` frames; a stationary mask."""
    w = by_frame()
    near = w.rangeBetween(-frames, frames)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = df.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    span = F.hypot(F.max("x").over(near) - F.min("x").over(near), F.max("y").over(near) - F.min("y").over(near))
    path = F.sum("_step").over(near) - F.first("_step").over(near)
    rows = rows.withColumns({"near": F.count("*").over(near), "span": span, "path": path}).drop("_step")
    return rows.withColumn("stationary", (F.col("near") >= 4) & (F.col("span") < 12) & (F.col("path") < 18))


def fill_gaps(df: DataFrame, max_gap: int = 6) -> DataFrame:
    """linear interpolation of runs of at most ``max_gap`` missing frames between two anchors; every frame of the gap must be there."""
    back, ahead = by_frame().rowsBetween(Window.unboundedPreceding, 0), by_frame().rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("detected"), F.struct("frame", "x", "y", "confidence"))
    rows = df.withColumns({"_p": F.last(seen, ignorenulls=True).over(back), "_n": F.first(seen, ignorenulls=True).over(ahead)})
    gap = Window.partitionBy(*KEY, "_p.frame", "_n.frame")
    missing = F.col("_n.frame") - F.col("_p.frame") - 1
    ok = ~F.col("detected") & (missing <= max_gap) & (F.sum(F.when(~F.col("detected"), 1).otherwise(0)).over(gap) == missing)
    share = (F.col("frame") - F.col("_p.frame")) / (F.col("_n.frame") - F.col("_p.frame"))
    fill = lambda c: F.when(ok, F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * share).otherwise(F.col(c))
    rows = rows.withColumns({"filled": F.coalesce(ok, F.lit(False)), "fx": fill("x"), "fy": fill("y"), "fc": F.when(ok, F.least(F.col("_p.confidence"), F.col("_n.confidence"))).otherwise(F.col("confidence"))})
    return rows.drop("_p", "_n")


def slopes(df: DataFrame, frames: int) -> DataFrame:
    """least-squares slopes of x and y before and after each frame (it included)."""
    before, after = by_frame().rangeBetween(-frames, 0), by_frame().rangeBetween(0, frames)
    return df.withColumns(
        {f"{c}_{side}": F.regr_slope(F.col(c), F.col("frame").cast("double")).over(w) for c in ("x", "y") for side, w in (("before", before), ("after", after))}
        | {"n_before": F.count("*").over(before), "n_after": F.count("*").over(after)}
    )


def line_valleys(df: DataFrame, lines: list[tuple[float, float]], limit: float = 80.0) -> DataFrame:
    """samples whose distance to the nearest line y = a x + b is a strict valley and within ``limit``."""
    w = by_frame()
    away = F.least(*[F.abs(a * F.col("x") - F.col("y") + b) / (a * a + 1) ** 0.5 for a, b in lines]) if len(lines) > 1 else F.abs(lines[0][0] * F.col("x") - F.col("y") + lines[0][1])
    rows = df.withColumn("distance", away)
    return rows.withColumns({"_a": F.lag("distance").over(w), "_b": F.lead("distance").over(w)}).filter("distance < _a AND distance < _b").filter(F.col("distance") <= limit).drop("_a", "_b")


def split_fit(df: DataFrame, half: int = 7, least: int = 3) -> DataFrame:
    """the best place to split the ``half`` samples on either side into two lines of y over frame, and how much of one line's squared error that saves.

    Sums over prefix windows give every split's error in closed form.
    """
    w = by_frame()
    near = df.withColumn("i", F.row_number().over(w)).select(*KEY, "i", "frame", F.col("y").cast("double").alias("y"))
    centre = near.filter(F.col("i") % half == 0).select(*KEY, F.col("i").alias("c"), F.col("frame").alias("centre"))
    rows = centre.join(near.withColumn("b", F.floor(F.col("i") / half)).select(*KEY, "i", "frame", "y", F.explode(F.array(*[(F.col("b") + d) * half for d in (-1, 0, 1, 2)])).alias("c")), [*KEY, "c"])
    rows = rows.filter(F.abs(F.col("i") - F.col("c")) <= half).withColumn("f", (F.col("frame") - F.col("centre")).cast("double"))
    g = Window.partitionBy(*KEY, "c").orderBy("i")
    left, right = g.rowsBetween(Window.unboundedPreceding, 0), g.rowsBetween(0, Window.unboundedFollowing)
    whole = g.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def sse(over) -> Column:
        n = F.count("*").over(over)
        s = lambda e: F.sum(e).over(over)
        f, y = F.col("f"), F.col("y")
        sff, sfy, syy = s(f * f) - s(f) * s(f) / n, s(f * y) - s(f) * s(y) / n, s(y * y) - s(y) * s(y) / n
        return F.greatest(F.lit(0.0), syy - F.coalesce(F.try_divide(sfy * sfy, F.when(sff > 0, sff)), F.lit(0.0)))

    rows = rows.withColumns({"two": sse(left) + sse(right), "one": sse(whole), "nl": F.count("*").over(left), "nr": F.count("*").over(right)})
    best = rows.filter((F.col("nl") >= least) & (F.col("nr") >= least)).groupBy(*KEY, "centre").agg(F.min(F.struct(F.round("two", 6).alias("two"), "i", "frame")).alias("b"), F.max("one").alias("one"))
    return best.select(*KEY, "centre", F.col("b.frame").alias("split_frame"), F.round(1 - F.try_divide(F.col("b.two"), F.when(F.col("one") > 0, F.col("one"))), 6).alias("improvement"))


def merge_candidates(*lists: DataFrame) -> DataFrame:
    """F16: one row per (run, frame): sources as a sorted set, requirements AND-ed, the largest score, the first value."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy(*KEY, "frame").agg(
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.bool_and("requires").alias("requires"), F.max("score").alias("score"),
        F.min_by("value", F.struct("seq", "source")).alias("value"),
    )


def local_maxima(df: DataFrame, value: str, threshold: DataFrame) -> DataFrame:
    """values over the run's threshold that neither neighbour exceeds."""
    w = by_frame()
    rows = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).join(threshold, KEY)
    return rows.filter((F.col(value) > F.col("threshold")) & (F.col(value) >= F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_a", "_b", "threshold")


def event_gaps(df: DataFrame) -> DataFrame:
    """time from the previous and to the next event."""
    w = by_frame()
    return df.withColumns({"gap_prev": F.col("t") - F.lag("t").over(w), "gap_next": F.lead("t").over(w) - F.col("t")})


def steps(df: DataFrame, keys: list[str], most: float) -> DataFrame:
    """time and speed (at most ``most``) from the sample before, for samples (t, x_ft, y_ft) of each key; pauses of no time are skipped."""
    w = Window.partitionBy(*keys).orderBy("t")
    step = F.hypot(F.col("x_ft") - F.lag("x_ft").over(w), F.col("y_ft") - F.lag("y_ft").over(w))
    rows = df.withColumns({"dt": F.col("t") - F.lag("t").over(w), "_step": step}).filter("dt > 0")
    return rows.withColumn("speed", F.least(F.lit(most), F.col("_step") / F.col("dt"))).drop("_step")


def velocity_around(df: DataFrame, frames: int) -> DataFrame:
    """speeds before and after each frame (it included), their ratio and the turn in degrees, for frames with two samples on either side."""
    rows = slopes(df, frames).filter("n_before >= 2 AND n_after >= 2")
    rows = rows.withColumns({"speed_before": F.hypot("x_before", "y_before"), "speed_after": F.hypot("x_after", "y_after")})
    both = F.col("speed_before") * F.col("speed_after")
    cosine = F.try_divide(F.col("x_before") * F.col("x_after") + F.col("y_before") * F.col("y_after"), F.when(both > 0, both))
    turn = F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    return rows.withColumns({"ratio": F.try_divide(F.col("speed_after"), F.when(F.col("speed_before") > 0, F.col("speed_before"))), "turn": turn})
