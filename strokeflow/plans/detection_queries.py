"""Queries over detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import detections as D
from . import bindings as B

DETECTIONS = """d AS (SELECT run_id, frame // 3 AS frame, row_number() OVER (PARTITION BY run_id, frame // 3 ORDER BY frame) - 1 AS det, x / 6 AS x, y / 6 AS y, width, height, confidence,
  CASE WHEN height > 4 THEN ' Ball' ELSE 'racket' END AS class_name FROM track WHERE detected)"""


def detections(spark, sf):
    det = F.row_number().over(Window.partitionBy("run_id", F.floor(F.col("frame") / 3)).orderBy("frame")) - 1
    kind = F.when(F.col("height") > 4, " Ball").otherwise("racket")
    return B.track(spark, sf).filter("detected").select(
        "run_id", F.floor(F.col("frame") / 3).alias("frame"), det.cast("long").alias("det"), (F.col("x") / 6).alias("x"), (F.col("y") / 6).alias("y"), "width", "height", "confidence", kind.alias("class_name")
    )


@register("c01_nested_boxes", f"WITH {DETECTIONS} SELECT run_id * 100000 + frame AS doc, det, class_name, confidence, round(x, 6) AS x, round(y, 6) AS y, width, height FROM d")
def c01(spark, sf):
    """Boxes at two depths of a document per frame, found again in pre-order; objects without a whole box are passed over."""
    box = F.struct("x", "y", "width", "height", F.col("class_name").alias("class"), "confidence")
    rows = detections(spark, sf).groupBy((F.col("run_id") * 100000 + F.col("frame")).alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("det", box.alias("b")))), lambda s: s["b"]).alias("boxes"))
    first, rest = F.get("boxes", F.lit(0)), F.slice("boxes", F.lit(2), F.greatest(F.size("boxes") - 1, F.lit(0)))
    body = F.to_json(F.struct(F.struct(first.alias("best"), F.struct(F.lit(1.0).alias("x"), F.lit("n").alias("name")).alias("meta")).alias("a_top"), F.array(F.struct(rest.alias("predictions"))).alias("data")))
    got = D.found(rows.select("doc", body.alias("body")))
    return got.select("doc", F.col("det").cast("long").alias("det"), "class_name", "confidence", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "width", "height")


@register(
    "c02_centred_boxes",
    f"WITH {DETECTIONS} SELECT run_id, frame, det, class_name AS class, class_name, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM d",
)
def c02(spark, sf):
    """Every other box given by its corners and a class by its other name."""
    corner, at = F.col("det") % 2 == 1, {"x": ("x", "width"), "y": ("y", "height")}
    d = detections(spark, sf)
    ends = {f"{c}_{end}": F.when(corner, F.col(p) + sign * F.col(size) / 2) for c, (p, size) in at.items() for end, sign in (("min", -1), ("max", 1))}
    d = d.withColumns(ends | {c: F.when(~corner, F.col(c)) for c in ("x", "y", "width", "height")} | {"class": F.when(corner, F.col("class_name")), "class_name": F.when(~corner, F.col("class_name"))})
    return D.centred(d).select("run_id", "frame", "det", "class", "class_name", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@register("c03_scaled_boxes", f"WITH {DETECTIONS} SELECT run_id, frame, det, round(x * 1.5, 6) AS x, round(y * 1.25, 6) AS y, round(width * 1.5, 6) AS width, round(height * 1.25, 6) AS height FROM d")
def c03(spark, sf):
    return D.scaled(detections(spark, sf), F.lit(1.5), F.lit(1.25)).select("run_id", "frame", "det", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@register("c04_candidates", f"WITH {DETECTIONS}, s AS (SELECT *, max(lower(trim(class_name)) = 'ball') OVER (PARTITION BY run_id, frame) AS any_ball FROM d WHERE coalesce(confidence, 1) >= 0.4) SELECT run_id, frame, det FROM s WHERE lower(trim(class_name)) = 'ball' OR NOT any_ball")
def c04(spark, sf):
    return D.candidates(detections(spark, sf), ["run_id", "frame"]).select("run_id", "frame", "det")


@register("c05_inside_frame", f"WITH {DETECTIONS} SELECT run_id, frame, det, x - width / 2 >= 20 AND y - height / 2 >= 20 AND x + width / 2 <= 140 AND y + height / 2 <= 130 AS inside FROM d")
def c05(spark, sf):
    return detections(spark, sf).select("run_id", "frame", "det", D.inside_frame(F.lit(160), F.lit(150), 20.0).alias("inside"))


@register(
    "d15_stationary",
    f"""WITH {DETECTIONS}, n AS (SELECT a.run_id, a.frame, a.det, b.frame AS pos_, arg_min(b.x, struct_pack(o := sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), d := b.det)) AS px, arg_min(b.y, struct_pack(o := sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), d := b.det)) AS py
        FROM d a JOIN d b ON a.run_id = b.run_id AND abs(a.frame - b.frame) <= 5 AND ((a.frame = b.frame AND a.det = b.det) OR (a.frame <> b.frame AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 25)) GROUP BY ALL),
      s AS (SELECT *, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) AS st FROM n WINDOW w AS (PARTITION BY run_id, frame, det ORDER BY pos_))
      SELECT run_id, frame, det, count(*) AS detected, round(sqrt(power(max(px) - min(px), 2) + power(max(py) - min(py), 2)), 5) AS span, round(coalesce(sum(st), 0), 5) AS path FROM s GROUP BY run_id, frame, det""",
)
def d15(spark, sf):
    return D.stationary(detections(spark, sf), 5, 25.0).withColumns({c: F.round(c, 5) for c in ("span", "path")})


#: The chain as SQL: ten steps through the five frames on either side, carrying the place that was reached.
CHAIN = """WITH RECURSIVE {d}, f AS (SELECT run_id, frame, list(struct_pack(det := det, x := x, y := y) ORDER BY det) AS dets FROM d GROUP BY run_id, frame),
  g AS (SELECT run_id, frame, det, x, y, 1 AS way FROM d UNION ALL SELECT run_id, frame, det, x, y, -1 FROM d),
  r AS (SELECT run_id, frame, det, way, 0 AS k, frame AS pos_, x AS px, y AS py, [struct_pack(f := frame, x := x, y := y)] AS pts FROM g
    UNION ALL SELECT run_id, frame, det, way, k + 1, CASE WHEN ok THEN nf ELSE pos_ END, CASE WHEN ok THEN n.x ELSE px END, CASE WHEN ok THEN n.y ELSE py END, CASE WHEN ok THEN list_append(pts, struct_pack(f := nf, x := n.x, y := n.y)) ELSE pts END
    FROM (SELECT *, coalesce(sqrt(power(n.x - px, 2) + power(n.y - py, 2)) <= 80 * abs(nf - pos_), false) AS ok FROM (
      SELECT r.*, r.frame + (r.k + 1) * r.way AS nf, list_sort(list_transform(f.dets, lambda p: struct_pack(o := sqrt(power(p.x - r.px, 2) + power(p.y - r.py, 2)), d := p.det, x := p.x, y := p.y)))[1] AS n
      FROM r LEFT JOIN f ON f.run_id = r.run_id AND f.frame = r.frame + (r.k + 1) * r.way WHERE r.k < 5))),
  p AS (SELECT DISTINCT run_id, frame, det, u.f AS pos_, u.x AS x, u.y AS y FROM (SELECT run_id, frame, det, unnest(pts) AS u FROM r WHERE k = 5)),
  s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS st FROM p WINDOW w AS (PARTITION BY run_id, frame, det ORDER BY pos_)),
  c AS (SELECT run_id, frame, det, count(*) AS detected, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS span, coalesce(sum(st), 0) AS path FROM s GROUP BY run_id, frame, det)"""


@register("d14_chained", f"{CHAIN.format(d=DETECTIONS)} SELECT run_id, frame, det, detected, round(span, 5) AS span, round(path, 5) AS path FROM c")
def d14(spark, sf):
    return D.chained(detections(spark, sf)).withColumns({c: F.round(c, 5) for c in ("span", "path")})


@register(
    "f08_motion_score",
    f"""{CHAIN.format(d=DETECTIONS)} SELECT run_id, frame, det, round(CASE WHEN detected < 2 THEN 0 WHEN span <= 8 AND path <= 10 THEN -0.4::DOUBLE ELSE 0.3::DOUBLE * greatest(least(1, span / 32), least(1, path / 40)) END, 6) AS score FROM c""",
)
def f08(spark, sf):
    score = D.motion_score(F.col("detected"), F.col("span"), F.col("path"))
    return D.chained(detections(spark, sf)).select("run_id", "frame", "det", F.round(score, 6).alias("score"))


@register("f09_motion_selection")
def f09(spark, sf):
    every = detections(spark, sf)
    got = D.select(D.candidates(every, ["run_id", "frame"], 0.2), every, supported=True, least=0.3)
    return got.withColumn("score", F.round("score", 6))


def people(spark, sf):
    """Up to three people in a frame, some frames without any."""
    s = B.samples(spark, sf).withColumn("frame", F.floor(F.col("t") * 4 / 3).cast("long"))
    w = Window.partitionBy("run_id", "frame").orderBy("track", "t")
    s = s.withColumn("det", F.row_number().over(w) - 1).filter("det < 3")
    none = F.col("frame") % 7 == 3
    return s.filter("NOT (%s) OR det = 0" % "frame % 7 = 3").select(
        "run_id", "frame", (F.col("frame") / 2).alias("t"), F.when(~none, F.col("det")).alias("det"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), (F.col("x_ft") / 21).alias("confidence")
    )


@register("g14_two_players")
def g14(spark, sf):
    return D.track_two(people(spark, sf))


@register(
    "d22_nearest_per_track",
    """WITH l AS (SELECT run_id, track, t, x_ft, y_ft FROM samples WHERE NOT coasted), a AS (SELECT run_id, min(t) + 10.1::DOUBLE AS ref FROM samples GROUP BY run_id),
      n AS (SELECT l.run_id, l.track, l.t, abs(l.t - a.ref) AS off, x_ft, y_ft FROM l JOIN a ON a.run_id = l.run_id),
      near AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY run_id, track ORDER BY off, t) = 1), strong AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY run_id, track ORDER BY x_ft DESC, y_ft DESC, t) = 1)
      SELECT n.run_id, n.track, CASE WHEN n.off <= 0.75 THEN n.t ELSE s.t END AS t, n.off <= 0.75 AS near FROM near n JOIN strong s ON s.run_id = n.run_id AND s.track = n.track""",
)
def d22(spark, sf):
    """The live sample nearest to a run's reference time, or else its strongest one (confidence, area, earliest)."""
    s = B.samples(spark, sf)
    ref = s.groupBy("run_id").agg((F.min("t") + 10.1).alias("ref"))
    live = s.filter("NOT coasted").join(ref, "run_id").withColumn("off", F.abs(F.col("t") - F.col("ref")))
    best = live.groupBy("run_id", "track").agg(F.min(F.struct("off", "t")).alias("n"), F.max_by("t", F.struct("x_ft", "y_ft", -F.col("t"))).alias("strong"))
    near = F.col("n.off") <= 0.75
    return best.select("run_id", "track", F.when(near, F.col("n.t")).otherwise(F.col("strong")).alias("t"), near.alias("near"))
