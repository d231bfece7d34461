"""Choosing, splitting and weighing examples, joins to their sources, medians of measurements, prominence of peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wall import y_at


def eligible(rows: DataFrame, clips: DataFrame, excluded: list[str], least_width: float) -> DataFrame:
    """C17: ``rows`` (clip, width and anything else) of clips that are not excluded and of a width at least; an excluded name that no clip has is an error."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, excluded)).cast("array<string>")).alias("clip"))
    unknown = names.join(clips.select("clip").distinct(), "clip", "left_anti").agg(F.array_sort(F.collect_list("clip")).alias("unknown"))
    checked = F.when(F.size("unknown") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown clips: "), F.array_join("unknown", ", "))).cast("boolean"))
    return rows.join(names, "clip", "left_anti").filter(F.col("width") >= least_width).crossJoin(F.broadcast(unknown.select(checked.alias("_ok")))).filter("_ok").drop("_ok")


def wall_region(cal: Column, x: Column, y: Column, pad_x: float, pad_below: float) -> Column:
    """Within the span of both lines and a pad, and above the tin (level beyond its ends) and a pad."""
    ends = [cal[line][c] for line in ("top", "bottom") for c in ("x0", "x1")]
    tin = cal["bottom"]
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - tin["x0"], tin["x1"] - tin["x0"])))
    level = F.when(tin["x0"] == tin["x1"], F.greatest(tin["y0"], tin["y1"])).otherwise(tin["y0"] + share * (tin["y1"] - tin["y0"]))
    return x.between(F.least(*ends) - pad_x, F.greatest(*ends) + pad_x) & (y <= level + pad_below)


def by_slug(clips: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``clips`` (clip) joined to ``videos`` (video) by their slugs (column slug of both), and the clips without one."""
    return clips.join(videos, "slug"), clips.join(videos.select("slug").distinct(), "slug", "left_anti")


def with_default(rows: DataFrame, by_source: DataFrame, default: Column) -> DataFrame:
    """``rows`` (source) with the geometry of their source, or the default."""
    return rows.join(by_source.select("source", F.col("geometry").alias("_own")), "source", "left").withColumn("geometry", F.coalesce("_own", default)).drop("_own")


def match_landmarks(a: DataFrame, b: DataFrame, within: float = 0.05) -> DataFrame:
    """Pairs of landmarks of two views (run_id, i, x, y), greedily: in the order of ``a``, each takes the nearest one of ``b`` that is left and nearer than ``within`` (the first of equals).

    A view has a handful of landmarks, all of which a row of the fold carries.
    """
    lists = lambda df, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias(name))
    both = lists(a, "a").join(lists(b, "b"), "run_id")
    kind = "array<struct<i:bigint,j:bigint,x:double,y:double>>"

    def step(acc: Column, p: Column) -> Column:
        free = F.filter("b", lambda q: ~F.exists(acc, lambda m: m["j"] == q["i"]))
        best = F.array_min(F.transform(free, lambda q: F.struct(F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("d"), q["i"].alias("j"), q["x"].alias("x"), q["y"].alias("y"))))
        pair = F.struct(p["i"].alias("i"), best["j"].alias("j"), ((p["x"] + best["x"]) / 2).alias("x"), ((p["y"] + best["y"]) / 2).alias("y"))
        return F.when(best["d"] < within, F.concat(acc, F.array(pair))).otherwise(acc)

    return both.select("run_id", F.inline(F.aggregate("a", F.array().cast(kind), step)))


def agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Number, median and largest of the errors (column error) of each key; finite ones only."""
    finite = pairs.filter(~F.isnan("error") & (F.abs("error") < float("inf")))
    return finite.groupBy(*keys).agg(F.count("*").alias("n"), F.median("error").alias("median_error"), F.max("error").alias("max_error"))


def projected_cost(profiles: DataFrame, ms_per_tile: Column, stride: int, sessions_per_day: int, cost_per_hour: float) -> DataFrame:
    """``profiles`` (tiles_per_frame, fps, duration) with frames, tiles, session_min, gpu_hours_day and usd_month."""
    frames = F.floor(F.floor(F.col("duration") * F.col("fps")) / stride)
    rows = profiles.withColumn("frames", frames).withColumn("tiles", F.col("tiles_per_frame") * F.col("frames"))
    seconds = F.col("tiles") * ms_per_tile / 1000
    return rows.withColumns({"session_min": seconds / 60, "gpu_hours_day": seconds * sessions_per_day / 3600, "usd_month": seconds * sessions_per_day / 3600 * 30 * cost_per_hour})


def players(samples_stats: DataFrame, ran: Column, rally_count: Column, backend: str) -> DataFrame:
    """Per run the assembled statistics of players A and B (rows run_id, track, distance_ft and coverage); null where the tier could not run, zeros where a player never moved."""
    row = lambda t: F.coalesce(F.first(F.when(F.col("track") == t, F.struct("distance_ft", "coverage")), ignorenulls=True), F.struct(F.lit(0.0).alias("distance_ft"), F.lit(0.0).alias("coverage")))
    per = samples_stats.groupBy("run_id").agg(row("A").alias("player_a"), row("B").alias("player_b"))
    made = F.struct(F.lit("players-v2").alias("schema"), F.lit(backend).alias("backend"), rally_count.alias("movement_rally_count"), "player_a", "player_b")
    return per.select("run_id", F.when(ran, made).alias("players"))


def reweighted(rows: DataFrame, false_positive: float, false_negative: float) -> DataFrame:
    """``rows`` (label, predicted) with balanced class weights, multiplied where the model was wrong."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    base = rows.join(F.broadcast(counts.crossJoin(total)), "label").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n")))
    factor = F.when((F.col("label") == 0) & (F.col("predicted") == 1), false_positive).when((F.col("label") == 1) & (F.col("predicted") == 0), false_negative).otherwise(1.0)
    return base.withColumn("weight", F.col("weight") * factor).drop("_n", "_all", "_k")


def split_by_clip(rows: DataFrame, val: list[str], test: list[str]) -> DataFrame:
    """``rows`` (clip) with the split of their clip: val, test, or else train; a clip in both lists is an error."""
    both = sorted({*val} & {*test})
    if both:
        raise ValueError(f"clips in both splits: {both}")
    return rows.withColumn("split", F.when(F.col("clip").isin(val), "val").when(F.col("clip").isin(test), "test").otherwise("train"))


def oversampled(rows: DataFrame, key: str, seed: str = "sample") -> DataFrame:
    """``rows`` (label 0 or 1, and a unique key) where rows of the smaller class repeat until both are as large: all of them equally often, and the remainder by a hash."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    ranked = rows.join(F.broadcast(counts.crossJoin(most)), "label").withColumn("_r", F.row_number().over(w))
    copies = F.floor(F.col("_most") / F.col("_n")) + (F.col("_r") <= F.col("_most") % F.col("_n")).cast("int")
    return ranked.select(*rows.columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))


def best_setting(results: DataFrame, keys: list[str], order: list[str], min_precision: float = 0.30, beta: float = 2.0) -> DataFrame:
    """Per key the setting (run_id of ``order`` first of equals) that meets the precision floor, then has the largest F-beta, recall, precision, F1 and accuracy."""
    p, r = F.col("precision"), F.col("recall")
    f = lambda b: F.coalesce(F.try_divide((1 + b * b) * p * r, b * b * p + r), F.lit(0.0))
    rows = results.withColumns({"f_beta": f(beta), "f1": f(1.0)})
    place = [(p >= min_precision).cast("int"), F.col("f_beta"), r, p, F.col("f1"), F.col("accuracy")]
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in place], *order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def worst_first(residuals: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Residuals ranked from the largest, the first of equals first."""
    return residuals.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("residual"), order)))


def prominent_peaks(series: DataFrame, value: str, rows: int, least: float) -> DataFrame:
    """local maxima (no neighbour exceeds them) that stand out by ``least`` from the median of ``rows`` rows around them, edges replicated.

    ``series`` has run_id and frame. The median is that of the window's rows and
    of as many copies of the first and last row as reach beyond the ends.
    """
    half = rows // 2
    w = Window.partitionBy("run_id").orderBy("frame")
    whole, near = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(-half, half)
    out = series.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("run_id")), "_first": F.first(value).over(whole), "_last": F.last(value).over(whole), "_near": F.collect_list(value).over(near), "_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    before, after = F.greatest(F.lit(0), half - F.col("_i") + 1), F.greatest(F.lit(0), half - (F.col("_n") - F.col("_i")))
    every = F.array_sort(F.concat(F.array_repeat("_first", before.cast("int")), F.col("_near"), F.array_repeat("_last", after.cast("int"))))
    out = out.withColumn("prominence", F.col(value) - F.get(every, F.lit(half)))
    return out.filter((F.col("prominence") >= least) & (F.col(value) >= F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_i", "_n", "_first", "_last", "_near", "_a", "_b")


def geometry_features(df: DataFrame, tin_left: Column, tin_right: Column) -> DataFrame:
    """``df`` (cal, x, y) with the features of a point against the wall's lines and the tin's ends; zeros without a position."""
    cal, x, y = F.col("cal"), F.col("x"), F.col("y")
    out = df.withColumns({"_t": y_at(cal["top"], x), "_b": y_at(cal["bottom"], x)})
    top, bottom = y - F.col("_t"), F.col("_b") - y
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumns({
        "inside_tin": zero(x.between(tin_left, tin_right).cast("double")), "to_left": zero(x - tin_left), "to_right": zero(tin_right - x),
        "wall_x": zero(F.when(tin_right > tin_left, F.try_divide(x - tin_left, tin_right - tin_left))), "to_out_line": zero(top), "to_tin_line": zero(bottom),
        "nearest_line": zero(F.least(F.abs(top), F.abs(bottom))), "wall_y": zero(F.when(F.col("_b") > F.col("_t"), F.try_divide(top, F.col("_b") - F.col("_t")))), "margin": zero(F.least(top, bottom)),
    }).drop("_t", "_b")


def frame_range(rows: DataFrame) -> DataFrame:
    """``rows`` (start_frame, start_seconds, end_frame, fps, frame_count) with first, last and error: the end is clipped to the clip; a start behind it and an empty range are errors."""
    first = F.coalesce("start_frame", F.floor(F.coalesce("start_seconds", F.lit(0.0)) * F.col("fps")))
    last = F.least(F.coalesce("end_frame", F.col("frame_count") - 1), F.col("frame_count") - 1)
    error = F.when(first >= F.col("frame_count"), "starts after the end").when(last < first, "ends before the start")
    return rows.withColumns({"first": first, "last": last, "error": error})


def parsed_grid(text: Column) -> Column:
    """The numbers of a comma-separated list, blanks passed over; null if there are none or one is malformed."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when((F.size(parts) > 0) & ~F.exists(numbers, lambda v: v.isNull()), numbers)


def valid_report(body: Column) -> Column:
    """Whether a coaching report has a summary and, for players 1 and 2, observations and a drill's name, instructions and goal, none of them blank."""
    player = "struct<observations:array<string>,drill_name:string,drill_instructions:string,drill_goal:string>"
    v = F.from_json(body, f"summary string, players struct<`1`:{player},`2`:{player}>")
    filled = lambda s: F.coalesce(F.trim(s) != "", F.lit(False))

    def good(p: Column) -> Column:
        said = F.coalesce((F.size(p["observations"]) > 0) & ~F.exists(p["observations"], lambda o: ~filled(o)), F.lit(False))
        return said & filled(p["drill_name"]) & filled(p["drill_instructions"]) & filled(p["drill_goal"])

    return F.coalesce(v["summary"].isNotNull() & good(v["players"]["1"]) & good(v["players"]["2"]), F.lit(False))


def safe_name(text: Column) -> Column:
    """A file name of ASCII letters, digits, dots, dashes and underscores, without folders and leading dots; null if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[/\\]+", " "), r"\s+", "_")
    return F.nullif(F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", ""), F.lit(""))


def setting(value: Column, default: Column) -> Column:
    """A setting given as text as a number, or the default where it is absent, blank or malformed."""
    return F.coalesce(F.trim(value).try_cast("double"), default)
