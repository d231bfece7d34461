"""Detections of a frame: normalisation, neighbours over frames, motion-consistent selection, two-player tracking.

``detections`` have run_id, frame, det (place within the frame), x, y and confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes that are balls, and thresholds of the selection.
BALL_CLASSES = ("ball", "squash ball", "squash-ball", "squash_ball")
MIN_SPAN, MIN_PATH, MIN_POINTS = 8.0, 10.0, 2
BONUS, PENALTY = 0.30, 0.40


def found(documents: DataFrame) -> DataFrame:
    """Every object of a JSON document (doc, body) that has a box, in pre-order: doc, det, class_name, confidence, x, y, width, height.

    Objects may lie at any depth; a step of the loop is one level of the
    documents, and ends where none has a deeper one. A box is x, y, width and
    height, or two corners in either spelling.
    """
    # A place in the document is a path of zero-padded steps, so that its order is pre-order.
    level = documents.select("doc", F.lit("").alias("place"), F.parse_json("body").alias("v"))
    parts = []
    while True:
        level = level.withColumn("kind", F.schema_of_variant("v"))
        parts.append(level.filter("kind LIKE 'OBJECT%'"))
        if level.filter("kind LIKE 'OBJECT<%' AND kind <> 'OBJECT<>' OR kind LIKE 'ARRAY%'").limit(1).count() == 0:
            break
        level = level.filter("kind LIKE 'OBJECT<%' OR kind LIKE 'ARRAY%'").lateralJoin(_children(level.sparkSession)).select("doc", F.concat("place", F.format_string("%06d.", "pos")).alias("place"), F.col("value").alias("v"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    get = lambda path, kind="double": F.try_variant_get("v", f"$.{path}", kind)
    whole = get("x").isNotNull() & get("y").isNotNull() & get("width").isNotNull() & get("height").isNotNull()
    boxes = rows.filter(whole).select(
        "doc", "place", F.coalesce(get("class", "string"), get("class_name", "string"), get("name", "string"), F.lit("object")).alias("class_name"),
        get("confidence").alias("confidence"), *[get(c).alias(c) for c in ("x", "y", "width", "height")],
    )
    return boxes.withColumn("det", F.row_number().over(Window.partitionBy("doc").orderBy("place")) - 1).drop("place")


def _children(spark) -> DataFrame:
    return spark.tvf.variant_explode(F.col("v").outer())


def centred(df: DataFrame) -> DataFrame:
    """``df`` (x, y, width, height, and x_min, y_min, x_max, y_max) with boxes of corners turned into boxes of centres where no centre is given; class and class_name fill each other."""
    corners = F.col("x_min").isNotNull() & F.col("y_min").isNotNull() & F.col("x_max").isNotNull() & F.col("y_max").isNotNull()
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    made = {"x": (F.col("x_min") + F.col("x_max")) / 2, "y": (F.col("y_min") + F.col("y_max")) / 2, "width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")}
    boxes = {c: F.when(whole | ~corners, F.col(c)).otherwise(v) for c, v in made.items()}
    return df.withColumns(boxes | {"class": F.coalesce("class", "class_name"), "class_name": F.coalesce("class_name", "class")})


def scaled(df: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Boxes back in source pixels; absent numbers stay absent."""
    across = [c for c in ("x", "width", "x_min", "x_max") if c in df.columns]
    down = [c for c in ("y", "height", "y_min", "y_max") if c in df.columns]
    return df.withColumns({c: F.col(c) * sx for c in across} | {c: F.col(c) * sy for c in down})


def candidates(df: DataFrame, keys: list[str], least: float = 0.40, classes: tuple[str, ...] = BALL_CLASSES) -> DataFrame:
    """Detections of at least a confidence (missing counts as 1): the balls, or all where a frame has no ball."""
    ball = F.coalesce(F.lower(F.trim("class_name")).isin(*classes), F.lit(False))
    sure = df.filter(F.coalesce("confidence", F.lit(1.0)) >= least).withColumn("_ball", ball)
    any_ball = F.max("_ball").over(Window.partitionBy(*keys))
    return sure.withColumn("_any", any_ball).filter("_ball OR NOT _any").drop("_ball", "_any")


def inside_frame(width: Column, height: Column, margin: float) -> Column:
    """The whole box lies in the frame, a margin away from its edges; false for boxes without numbers and empty frames."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    inside = (x - w / 2 >= margin) & (y - h / 2 >= margin) & (x + w / 2 <= width - margin) & (y + h / 2 <= height - margin)
    return F.coalesce(inside & (width > 0) & (height > 0), F.lit(False))


def _spread(points: DataFrame, keys: list[str]) -> DataFrame:
    """detected, span and path of points (keys, at, px, py) in the order of ``at``."""
    w = Window.partitionBy(*keys).orderBy("at")
    steps = points.withColumn("_step", F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)))
    span = F.hypot(F.max("px") - F.min("px"), F.max("py") - F.min("py"))
    return steps.groupBy(*keys).agg(F.count("*").alias("detected"), span.alias("span"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"))


def _nearby(detections: DataFrame, frames: int) -> DataFrame:
    """Each detection beside those of all frames within ``frames``: an equi-join on (run, frame), a frame listed under each it is near to."""
    own = detections.select("run_id", "frame", "det", "x", "y")
    offsets = F.explode(F.sequence(F.lit(-frames), F.lit(frames)))
    other = detections.select("run_id", F.col("frame").alias("at"), F.col("det").alias("pdet"), F.col("x").alias("px"), F.col("y").alias("py"), offsets.alias("d"))
    return own.join(other.withColumn("frame", F.col("at") + F.col("d")).drop("d"), ["run_id", "frame"])


def stationary(detections: DataFrame, frames: int = 5, radius: float = 8.0) -> DataFrame:
    """Detected, span and path per detection over the nearest detection, within ``radius``, of each frame within ``frames``; itself for its own frame."""
    off = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    near = _nearby(detections, frames).withColumn("off", off)
    near = near.filter("(at = frame AND pdet = det) OR (at <> frame AND off <= %r)" % radius)
    first = F.min(F.struct("off", "pdet", "px", "py")).alias("p")
    points = near.groupBy("run_id", "frame", "det", "at").agg(first).select("run_id", "frame", "det", "at", "p.px", "p.py")
    return _spread(points, ["run_id", "frame", "det"])


def chained(detections: DataFrame, frames: int = 5, max_step: float = 80.0) -> DataFrame:
    """Detected, span and path per detection over a chain in both directions.

    From a detection the chain goes to the nearest one of the next frame that
    has any, if it is within ``max_step`` a frame, else the frame is passed over;
    and so on from where it stands, for ``frames`` frames. Each step depends on
    the one before, so it is a fold over the neighbouring frames' detections,
    which is all that a row carries.
    """
    other = detections.groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(F.struct("det", "x", "y"))).alias("dets"))
    spread = other.select("run_id", F.col("frame").alias("at"), "dets", F.explode(F.sequence(F.lit(-frames), F.lit(frames))).alias("d")).withColumn("frame", F.col("at") + F.col("d")).filter("d <> 0")
    lists = spread.groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(F.struct("at", "dets"))).alias("near"))
    rows = detections.select("run_id", "frame", "det", "x", "y").join(lists, ["run_id", "frame"], "left")
    point = lambda at, x, y: F.struct(at.alias("at"), x.alias("px"), y.alias("py"))
    start = F.struct(F.col("frame").alias("at"), F.col("x").alias("px"), F.col("y").alias("py"))

    def step(acc: Column, f: Column) -> Column:
        here = F.get(acc, F.size(acc) - 1)
        nearest = F.array_min(F.transform(f["dets"], lambda p: F.struct(F.hypot(p["x"] - here["px"], p["y"] - here["py"]).alias("off"), p["det"].alias("det"), p["x"].alias("x"), p["y"].alias("y"))))
        linked = F.concat(acc, F.array(point(f["at"], nearest["x"], nearest["y"])))
        return F.when(nearest["off"] <= max_step * F.abs(f["at"] - here["at"]), linked).otherwise(acc)

    near = F.coalesce("near", F.filter("near", lambda f: F.lit(False)), F.array().cast("array<struct<at:bigint,dets:array<struct<det:bigint,x:double,y:double>>>>"))
    rows = rows.withColumn("near", near)
    ahead = F.aggregate(F.filter("near", lambda f: f["at"] > F.col("frame")), F.array(start), step)
    back = F.aggregate(F.reverse(F.filter("near", lambda f: f["at"] < F.col("frame"))), F.array(start), step)
    points = rows.select("run_id", "frame", "det", F.inline(F.concat(ahead, F.slice(back, F.lit(2), F.greatest(F.size(back) - 1, F.lit(0))))))
    return _spread(points, ["run_id", "frame", "det"])


def motion_score(detected: Column, span: Column, path: Column) -> Column:
    """a bonus for motion, a penalty for standing still, nothing for single points."""
    still = (span <= MIN_SPAN) & (path <= MIN_PATH)
    moved = BONUS * F.greatest(F.least(F.lit(1.0), span / (4 * MIN_SPAN)), F.least(F.lit(1.0), path / (4 * MIN_PATH)))
    return F.when(detected < MIN_POINTS, 0.0).when(still, -PENALTY).otherwise(moved)


def select(detections: DataFrame, frames: DataFrame, window: int = 5, supported: bool = False, least: float | None = None) -> DataFrame:
    """at most one detection for each of ``frames`` (run_id, frame): det and score, null where none is left.

    Detections that stand still go first; then, if ``supported``, those without
    a chain, and those below ``least``; of the rest the largest sum of confidence
    and motion score wins, the first of equals. ``detections`` are the candidates
    of :func:`candidates`.
    """
    keys = ["run_id", "frame", "det"]
    rows = detections.join(chained(detections, window), keys).join(stationary(detections, window).toDF(*keys, "n_still", "span_still", "path_still"), keys)
    rows = rows.filter(~((F.col("n_still") >= MIN_POINTS) & (F.col("span_still") <= MIN_SPAN) & (F.col("path_still") <= MIN_PATH)))
    sure = F.coalesce("confidence", F.lit(1.0))
    if supported:
        rows = rows.filter(F.col("detected") >= MIN_POINTS)
    if least is not None:
        rows = rows.filter(sure >= least)
    rows = rows.withColumn("score", sure + motion_score(F.col("detected"), F.col("span"), F.col("path")))
    best = rows.groupBy("run_id", "frame").agg(F.min(F.struct((-F.col("score")).alias("s"), "det")).alias("b")).select("run_id", "frame", "b.det", (-F.col("b.s")).alias("score"))
    return frames.select("run_id", "frame").distinct().join(best, ["run_id", "frame"], "left")


def track_two(people: DataFrame, coast_s: float = 1.0, margin: float = 0.2) -> DataFrame:
    """Samples of two players (track A or B) from detections of people (run_id, frame, t, det, x, y as feet, confidence; det null for a frame without any).

    The two surest detections of a frame count. The leftmost of the first frame
    with any is A; the first other one, further from A, is B. Then detections go
    to tracks so that feet move least in all; where both ways cost nearly the
    same the frame is ambiguous. A track without a detection stays where it was
    for ``coast_s`` seconds. Each frame depends on the one before: a run is
    folded in the order of its frames, one row at a time, in constant memory.
    """
    schema = "run_id long, frame long, t double, track string, x double, y double, coasted boolean, ambiguous boolean"
    w = Window.partitionBy("run_id", "frame").orderBy(F.desc("confidence"), "det")
    top = people.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    ordered = top.repartition("run_id").sortWithinPartitions("run_id", "frame", "_n").select("run_id", "frame", "t", "det", "x", "y")

    def away(p: tuple, q: tuple) -> float:
        return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        place: dict[str, tuple] = {}
        live: dict[str, float] = {}
        out: list[tuple] = []

        def frame(run, number, t, feet) -> None:
            ambiguous = False
            seen: dict[str, tuple] = {}
            if "A" not in place:
                seen = dict(zip("AB", sorted(feet, key=lambda p: p[0])))
            elif "B" not in place and len(feet) == 2:
                seen = dict(zip("AB", sorted(feet, key=lambda p: away(p, place["A"]))))
            elif "B" not in place:
                seen = {"A": feet[0]} if feet else {}
            elif len(feet) == 1:
                seen = {"A" if away(feet[0], place["A"]) <= away(feet[0], place["B"]) else "B": feet[0]}
            elif feet:
                straight = away(feet[0], place["A"]) + away(feet[1], place["B"])
                crossed = away(feet[1], place["A"]) + away(feet[0], place["B"])
                low, high = sorted((straight, crossed))
                ambiguous = high > 0 and low >= (1 - margin) * high
                seen = dict(zip("AB", feet if straight <= crossed else feet[::-1]))
            for track in "AB":
                if track in seen:
                    place[track], live[track] = seen[track], t
                    out.append((run, number, t, track, *seen[track], False, ambiguous))
                elif track in place and t - live[track] <= coast_s:
                    # Only a frame in which a track could have been seen lets it coast.
                    if "B" in place or not feet:
                        out.append((run, number, t, track, *place[track], True, ambiguous))

        held: tuple | None = None  # the frame that is being gathered
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for r, f, t, det, x, y in zip(*(batch[c] for c in ("run_id", "frame", "t", "det", "x", "y"))):
                if held is not None and (held[0], held[1]) != (r, f):
                    frame(*held)
                    held = None
                if r != run:
                    run, place, live = r, {}, {}
                if held is None:
                    held = (r, f, t, [])
                if det == det and det is not None:
                    held[3].append((x, y))
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held is not None:
            frame(*held)
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(fold, schema)
