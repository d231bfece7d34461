"""Sessions, islands, intervals and order-dependent state, for all runs in one plan.

Every window is partitioned by run, so a run is the unit of parallelism; folds
(HOF aggregates over one run's short event list) are used only where a step
depends on what the fold itself decided before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id"]


def islands(df: DataFrame, breaks: Column, order: list[str], name: str = "island", keys: list[str] = KEY) -> DataFrame:
    """Number runs of rows from 1; a row where ``breaks`` holds begins a new one. ``breaks`` may use ``lag`` windows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long")).withColumn(name, F.sum("_break").over(w) + 1).drop("_break")


def split_tracks(df: DataFrame, max_gap: int = 3, max_jump: float = 200.0) -> DataFrame:
    """A new track after a gap of more than ``max_gap`` frames or a step of more than ``max_jump`` pixels a frame."""
    w = Window.partitionBy(*KEY).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / gap
    return islands(df, (gap > max_gap) | (step > max_jump), ["frame"], "track_no")


def adaptive_gap(events: DataFrame, ratio: float = 1.75, least: float = 4.0, default: float = 5.0) -> DataFrame:
    """Per run the gap (column ``threshold``) that parts sessions, and the method.

    Positive gaps are sorted; of neighbours whose upper is at least ``least``
    and ``ratio`` times the lower, the pair with the largest ratio (the first
    of equals) gives its midpoint; without one, ``default``.
    """
    by_time = Window.partitionBy(*KEY).orderBy("frame")
    gaps = events.select(*KEY, "frame", (F.col("t") - F.lag("t").over(by_time)).alias("gap")).filter("gap > 0")
    by_gap = Window.partitionBy(*KEY).orderBy("gap", "frame")
    pairs = gaps.select(*KEY, F.col("gap").alias("low"), F.lead("gap").over(by_gap).alias("high"))
    best = pairs.filter((F.col("high") >= least) & (F.col("high") >= ratio * F.col("low"))).groupBy(*KEY).agg(
        F.max_by((F.col("low") + F.col("high")) / 2, F.struct(F.col("high") / F.col("low"), -F.col("low"))).alias("threshold")
    )
    method = F.when(F.col("threshold").isNull(), "default").otherwise("adaptive")
    return events.select(*KEY).distinct().join(best, KEY, "left").select(*KEY, F.coalesce("threshold", F.lit(default)).alias("threshold"), method.alias("method"))


def segment(events: DataFrame, gaps: DataFrame | float, inclusive: bool = True) -> DataFrame:
    """``rally_number`` from 1; a gap of at least (G03: more than) the threshold parts rallies."""
    w = Window.partitionBy(*KEY).orderBy("frame")
    rows = events.withColumn("gap", F.col("t") - F.lag("t").over(w))
    rows = rows.withColumn("threshold", F.lit(gaps)) if isinstance(gaps, float) else rows.join(gaps.select(*KEY, "threshold"), KEY)
    breaks = F.col("gap") >= F.col("threshold") if inclusive else F.col("gap") > F.col("threshold")
    return islands(rows, breaks, ["frame"], "rally_number").drop("threshold")


def numbered(rally_hits: DataFrame) -> DataFrame:
    """sequence over all hits and within the rally."""
    return rally_hits.withColumn("sequence", F.row_number().over(Window.partitionBy(*KEY).orderBy("frame"))).withColumn(
        "rally_hit_sequence", F.row_number().over(Window.partitionBy(*KEY, "rally_number").orderBy("frame"))
    )


def active_spans(series: DataFrame, threshold: DataFrame) -> DataFrame:
    """Maximal stretches of energy above the run's threshold: first and last active time."""
    w = Window.partitionBy(*KEY).orderBy("t", "frame")
    rows = series.join(threshold, KEY).withColumn("on", F.col("energy") > F.col("threshold"))
    rows = rows.withColumn("_change", F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(1))).withColumn("span", F.sum("_change").over(w))
    return rows.filter("on").groupBy(*KEY, "span").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).drop("span")


def merge_intervals(spans: DataFrame, bridge: float = 0.0) -> DataFrame:
    """Union of intervals that overlap or lie within ``bridge`` of the furthest end so far."""
    w = Window.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce((F.col("start") - reach > bridge).cast("int"), F.lit(0))).withColumn("_i", F.sum("_new").over(w))
    return rows.groupBy(*KEY, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("_i")


def serve_faults(rally_hits: DataFrame) -> DataFrame:
    """Each hit of a rally's leading OUT prefix becomes a rally of its own; rallies are numbered anew."""
    w = Window.partitionBy(*KEY, "rally_number").orderBy("frame")
    fault = F.coalesce(F.col("call") == "OUT", F.lit(False))
    rows = rally_hits.withColumn("_open", F.sum((~fault).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # A hit begins a rally if it is the first, or all hits before it in its rally were faults.
    return islands(rows, F.coalesce(F.col("_open"), F.lit(0)) == 0, ["frame"], "rally_number_split").withColumn(
        "rally_number_split", F.col("rally_number_split") - 1
    ).drop("_open")


def rallies(rally_hits: DataFrame) -> DataFrame:
    """One row per rally: frames, times, hits, first and last call."""
    first, last = F.struct("frame"), F.struct("frame")
    return rally_hits.groupBy(*KEY, "rally_number").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        F.count("*").alias("n_hits"), F.min_by("call", first).alias("serve_call"), F.max_by("call", last).alias("last_call"),
    )


def server_chain(per_rally: DataFrame) -> DataFrame:
    """Server and winner of each rally, without serve observations.

    Player 1 serves first; players alternate within a rally; a serve OUT or a
    last OUT loses for who hit it, a last IN wins, no call decides nothing; the
    winner serves next. Equivalent to counting, before each rally, those that
    pass the serve on, so one window replaces the fold.
    """
    odd = F.col("n_hits") % 2 == 1
    serve_out = F.coalesce(F.col("serve_call") == "OUT", F.lit(False))
    flips = serve_out | F.coalesce((F.col("last_call") == "OUT") & odd, F.lit(False)) | F.coalesce((F.col("last_call") == "IN") & ~odd, F.lit(False))
    w = Window.partitionBy(*KEY).orderBy("rally_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = per_rally.withColumn("_flip", flips.cast("int")).withColumn("server", (F.coalesce(F.sum("_flip").over(w), F.lit(0)) % 2 + 1).cast("int"))
    winner = F.when(serve_out | F.col("last_call").isNotNull(), F.when(F.col("_flip") == 1, 3 - F.col("server")).otherwise(F.col("server")))
    reason = F.when(serve_out, "serve_out").when(F.col("last_call") == "OUT", "last_out").when(F.col("last_call") == "IN", "last_in")
    return rows.withColumn("winner", winner).withColumn("winner_reason", reason).drop("_flip")


def running_score(chained: DataFrame) -> DataFrame:
    """Score of both players after each rally."""
    w = Window.partitionBy(*KEY).orderBy("rally_number")
    return chained.withColumns({f"score_{p}": F.sum(F.when(F.col("winner") == p, 1).otherwise(0)).over(w) for p in (1, 2)})


def backfill_winners(chained: DataFrame, observed: DataFrame) -> DataFrame:
    """A rally without a winner takes the next rally's observed server; a winner who disagrees is marked."""
    w = Window.partitionBy(*KEY).orderBy("rally_number")
    rows = chained.join(observed, [*KEY, "rally_number"], "left").withColumn("next_server", F.lead("observed_server").over(w))
    return rows.withColumns(
        {
            "winner_final": F.coalesce("winner", "next_server"),
            "winner_source": F.when(F.col("winner").isNotNull(), "calls").when(F.col("next_server").isNotNull(), "next_serve"),
            "agrees": F.col("winner") == F.col("next_server"),
        }
    )


def suppress_peaks(peaks: DataFrame, min_gap: int, top_k: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression: by score descending (then input order), keep what is ``min_gap`` frames from all kept.

    A fold over one run's candidates; ``peaks`` has frame, score, seq.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "seq", "frame")))
    grouped = peaks.groupBy(*KEY).agg(ordered.alias("p"))
    kept = F.aggregate(
        "p",
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda k: F.abs(k - x["frame"]) < min_gap) | (F.size(acc) >= (top_k if top_k is not None else (1 << 30))), acc
        ).otherwise(F.concat(acc, F.array(x["frame"]))),
    )
    return grouped.select(*KEY, F.posexplode(kept).alias("rank", "frame"))


def thin_bursts(rows: DataFrame, min_gap: int) -> DataFrame:
    """Keep a row if it is ``min_gap`` frames after the last kept one."""
    grouped = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list("frame")).alias("f"))
    kept = F.aggregate(
        "f",
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when(F.coalesce(x - F.get(acc, F.size(acc) - 1) >= min_gap, F.lit(True)), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return grouped.select(*KEY, F.explode(kept).alias("frame"))


def clamp_timeline(spans: DataFrame, duration: float, pad: float = 0.5) -> DataFrame:
    """G08, last step: pad spans, clamped to the clip and to the end of the last emitted one; empty ones are skipped.

    Each start depends on the previous output, so it is a fold over a run's spans.
    """
    grouped = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "n"))).alias("s"))
    folded = F.aggregate(
        "s",
        F.struct(F.lit(0.0).alias("last"), F.array().cast("array<struct<start:double,end:double,n:bigint>>").alias("out")),
        lambda acc, x: _emit(acc, F.greatest(x["start"] - pad, acc["last"], F.lit(0.0)), F.least(x["end"] + pad, F.lit(duration)), x["n"]),
    )
    return grouped.select(*KEY, F.inline(folded["out"])).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / F.lit(4)))


def _emit(acc: Column, start: Column, end: Column, n: Column) -> Column:
    row = F.struct(start.alias("start"), end.alias("end"), n.alias("n"))
    return F.struct(
        F.when(end > start, end).otherwise(acc["last"]).alias("last"), F.when(end > start, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out")
    )


def cadence(rows: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th observed frame, from the first."""
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("frame"))
    return rows.withColumn("_n", n).filter((F.col("_n") - 1) % every == 0).drop("_n")


def first_observation(rows: DataFrame) -> DataFrame:
    """The first observation of a frame wins."""
    n = F.row_number().over(Window.partitionBy(*KEY, "frame").orderBy("seq"))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def refine_windows(hits: DataFrame, radius: int, start: int | Column, end: int | Column) -> DataFrame:
    """Frame windows around hits, clipped, with touching ones merged."""
    spans = hits.select(*KEY, F.greatest(F.col("frame") - radius, F.lit(start)).alias("start"), F.least(F.col("frame") + radius, F.lit(end)).alias("end"))
    return merge_intervals(spans.filter("start <= end"), bridge=1)


def suppress_boxes(boxes: DataFrame, keys: list[str], iou: float) -> DataFrame:
    """Greedy suppression of boxes (x0, y0, x1, y1, score, seq) of one frame whose overlap over union with a kept one reaches ``iou``."""
    box = F.struct((-F.col("score")).alias("s"), "seq", "x0", "y0", "x1", "y1")
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])

    def overlaps(a: Column, b: Column) -> Column:
        w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
        h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
        return both >= iou * (area(a) + area(b) - both)

    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"))
    none = F.filter("b", lambda x: F.lit(False))
    kept = F.aggregate("b", none, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select(*keys, F.explode(F.transform(kept, lambda k: k["seq"])).alias("seq"))


def plausible_chunks(points: DataFrame, base: float, per_frame: float) -> DataFrame:
    """Points that are not further from the last accepted one than ``base`` + ``per_frame`` per frame; a fold over one run, as the reference point is the last accepted."""
    grouped = points.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        far = F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > base + per_frame * (p["frame"] - last["frame"])
        return F.when(F.coalesce(far, F.lit(False)), acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate("p", F.filter("p", lambda x: F.lit(False)), step)
    return grouped.select(*KEY, F.inline(kept))


def wall_chunks(points: DataFrame, base: float, per_frame: float) -> DataFrame:
    """Chunks of plausible points (frame, x, y, inside the gate, score if a candidate) with the best candidate of each, the first of equals.

    A plausible point outside the gate ends the chunk and forgets the last accepted point; chunks without a candidate are left out.
    """
    finite = points.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    grouped = finite.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y", "inside", "score"))).alias("p"))
    member = lambda p, n: F.struct(p["frame"].alias("frame"), p["x"].alias("x"), p["y"].alias("y"), p["score"].alias("score"), n.alias("chunk"))
    state = lambda open_, n, kept: F.struct(open_.alias("open"), n.alias("n"), kept.alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc["kept"], F.size(acc["kept"]) - 1)
        far = acc["open"] & (F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > base + per_frame * (p["frame"] - last["frame"]))
        n = acc["n"] + (~acc["open"]).cast("int")
        taken = state(F.lit(True), n, F.concat(acc["kept"], F.array(member(p, n))))
        return F.when(F.coalesce(far, F.lit(False)), acc).when(F.coalesce(p["inside"], F.lit(False)), taken).otherwise(state(F.lit(False), acc["n"], acc["kept"]))

    none = F.filter(F.transform("p", lambda p: member(p, F.lit(0))), lambda x: F.lit(False))
    kept = grouped.select(*KEY, F.inline(F.aggregate("p", state(F.lit(False), F.lit(0), none), step)["kept"]))
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("frame")).alias("back"))))
    chunks = kept.groupBy(*KEY, "chunk").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("frames"), F.count("score").alias("candidates"), best.alias("best"))
    return chunks.filter("candidates > 0").select(*KEY, "start_frame", "end_frame", "frames", "candidates", (-F.col("best.back")).alias("frame"), F.col("best.score").alias("score"))
