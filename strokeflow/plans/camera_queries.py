"""Queries over homographies, distortion, cameras, image lines and court geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import camera as V
from ..operators import judging as J
from . import bindings as B

H = [0.02, 0.001, 1.0, -0.0005, 0.03, 2.0, 0.00001, 0.0002, 1.0]


def seen(spark, sf):
    return B.track(spark, sf).filter("detected")


def fixed(df, digits=6, **columns):
    return df.select("run_id", "frame", *[F.round(c, digits).alias(n) for n, c in columns.items()])


@register(
    "j07_floor_zone",
    """WITH p AS (SELECT run_id, track, t, least(21, greatest(0, x_ft - 1)) AS x, least(32, greatest(0, y_ft + 1)) AS y FROM samples)
      SELECT run_id, track, t, least(3, CAST(floor(y / 32 * 4) AS INT)) * 3 + least(2, CAST(floor(x / 21 * 3) AS INT)) + 1 AS zone, round_even(x, 2) AS x_ft, y >= 18 AS behind_short_line,
      y BETWEEN 18 AND 23.25 AND x <= 5.25 AS in_left_service_box, y BETWEEN 18 AND 23.25 AND x >= 15.75 AS in_right_service_box, CASE WHEN x < 10.5 THEN 'left' ELSE 'right' END AS side FROM p""",
)
def j07(spark, sf):
    z = B.samples(spark, sf).select("run_id", "track", "t", V.floor_zone(F.col("x_ft") - 1, F.col("y_ft") + 1).alias("z"))
    return z.select("run_id", "track", "t", *[F.col(f"z.{c}").alias(c) for c in ("zone", "x_ft", "behind_short_line", "in_left_service_box", "in_right_service_box", "side")])


@register(
    "j09_homography_round_trip",
    """WITH p AS (SELECT run_id, frame, x, y, 0.00001::DOUBLE * x + 0.0002::DOUBLE * y + 1 AS w FROM track WHERE detected)
      SELECT run_id, frame, round((0.02 * x + 0.001 * y + 1) / w, 6) AS u, round((-0.0005::DOUBLE * x + 0.03 * y + 2) / w, 6) AS v, round(x, 5) AS x, round(y, 5) AS y FROM p""",
)
def j09(spark, sf):
    h = F.array(*map(F.lit, H))
    rows = seen(spark, sf).withColumn("p", V.apply_homography(h, F.col("x"), F.col("y"))).withColumn("q", V.apply_homography(V.invert_homography(h), F.col("p.u"), F.col("p.v")))
    return rows.select("run_id", "frame", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"), F.round("q.u", 5).alias("x"), F.round("q.v", 5).alias("y"))


@register(
    "j09_undistort",
    """WITH p AS (SELECT run_id, frame, x, y, x - 500 AS dx, y - 400 AS dy, 1 + CASE WHEN run_id % 3 > 0 THEN -0.08::DOUBLE END * ((power(x - 500, 2) + power(y - 400, 2)) / 1e6::DOUBLE) AS f FROM track WHERE detected)
      SELECT run_id, frame, round(CASE WHEN f IS NULL THEN x ELSE 500 + dx / f END, 6) AS ux, round(CASE WHEN f IS NULL THEN y ELSE 400 + dy / f END, 6) AS uy, round(x, 5) AS back_x, round(y, 5) AS back_y FROM p""",
)
def j09_undistort(spark, sf):
    """Undistorted, and distorted again."""
    k1 = F.when(F.col("run_id") % 3 > 0, -0.08)
    lens = (k1, F.lit(500.0), F.lit(400.0), F.lit(1000.0))
    rows = seen(spark, sf).withColumn("u", V.undistort(F.col("x"), F.col("y"), *lens)).withColumn("d", V.distort(F.col("u.x"), F.col("u.y"), *lens))
    return rows.select("run_id", "frame", F.round("u.x", 6).alias("ux"), F.round("u.y", 6).alias("uy"), F.round("d.x", 5).alias("back_x"), F.round("d.y", 5).alias("back_y"))


#: A camera behind the back wall, looking at the front wall and a little down.
COS, SIN = 0.96, 0.28
CAMERA = {"rotation": [1.0, 0.0, 0.0, 0.0, -SIN, -COS, 0.0, -COS, SIN], "center": [10.5, 40.0, 12.0], "focal": 900.0, "cx": 480.0, "cy": 270.0}


def camera():
    c = CAMERA
    return F.struct(F.array(*map(F.lit, c["rotation"])).alias("rotation"), F.array(*map(F.lit, c["center"])).alias("center"), *[F.lit(c[k]).alias(k) for k in ("focal", "cx", "cy")])


def contacts(spark, sf):
    """Court points with a height and a surface."""
    s = B.samples(spark, sf).withColumn("z", F.pmod(F.col("t") * 4, F.lit(37)) / 2 - 0.9)
    names = F.array(*map(F.lit, ("floor", "front_wall", "left_wall", "right_wall", "back_wall")))
    return s.withColumn("surface", F.get(names, F.pmod(F.col("t") * 4, F.lit(5)).cast("int")))


CONTACTS = "p AS (SELECT run_id, track, t, x_ft, y_ft, (t * 4) % 37 / 2 - 0.9::DOUBLE AS z, ['floor', 'front_wall', 'left_wall', 'right_wall', 'back_wall'][CAST((t * 4) % 5 AS INT) + 1] AS surface FROM samples)"
AXES = f"c AS (SELECT *, x_ft - 10.5 AS px, -{SIN} * (y_ft - 40) - {COS} * (z - 12) AS py, -{COS} * (y_ft - 40) + {SIN} * (z - 12) AS pz FROM p)"


@register(
    "j10_camera",
    f"""WITH {CONTACTS}, {AXES}, u AS (SELECT *, 900 * px / pz AS ru, 900 * py / pz AS rv FROM c WHERE pz > 1e-9)
      SELECT run_id, track, t, round(ru + 480, 5) + 0.0 AS u, round(rv + 270, 5) + 0.0 AS v, round(pz, 6) AS depth, round((-{SIN} * (rv / 900) - {COS}) / sqrt(power(ru / 900, 2) + power(rv / 900, 2) + 1), 6) AS dy, round((ru + 480) / 2, 5) + 0.0 AS half_u FROM u""",
)
def j10(spark, sf):
    cam, p = camera(), [F.col("x_ft"), F.col("y_ft"), F.col("z")]
    rows = contacts(spark, sf).withColumns({"p": V.project(cam, *p), "half": V.project(V.scale_camera(cam, F.lit(0.5)), *p), "depth": V.depth(cam, *p)}).filter("p IS NOT NULL")
    rows = rows.withColumn("r", V.ray(cam, F.col("p.u"), F.col("p.v")))
    return rows.select("run_id", "track", "t", (F.round("p.u", 5) + 0.0).alias("u"), (F.round("p.v", 5) + 0.0).alias("v"), F.round("depth", 6).alias("depth"), F.round("r.dy", 6).alias("dy"), (F.round("half.u", 5) + 0.0).alias("half_u"))


@register(
    "j16_surface_calls",
    f"""WITH {CONTACTS}, l AS (SELECT *, CASE WHEN surface = 'back_wall' THEN 7 ELSE 15 - 8 * (y_ft / 32) END AS line FROM p)
      SELECT run_id, track, t, CASE surface WHEN 'floor' THEN 'bounce' WHEN 'front_wall' THEN CASE WHEN z >= 15 THEN 'out' WHEN z <= 19.0::DOUBLE / 12 THEN 'down' ELSE 'in' END ELSE CASE WHEN z >= line THEN 'out' ELSE 'in' END END AS call,
      round(CASE surface WHEN 'floor' THEN 0 WHEN 'front_wall' THEN CASE WHEN z >= 15 THEN z - 15 WHEN z <= 19.0::DOUBLE / 12 THEN 19.0::DOUBLE / 12 - z ELSE least(15 - z, z - 19.0::DOUBLE / 12) END ELSE abs(z - line) END, 6) AS margin FROM l""",
)
def j16_calls(spark, sf):
    rows = contacts(spark, sf).withColumn("c", V.surface_call(F.col("surface"), F.col("x_ft"), F.col("y_ft"), F.col("z")))
    return rows.select("run_id", "track", "t", "c.call", F.round("c.margin", 6).alias("margin"))


@register(
    "j16_snap_to_plane",
    f"""WITH {CONTACTS}, {AXES}, r AS (SELECT *, px / pz AS a, py / pz AS b FROM c WHERE pz > 1e-9), d AS (SELECT *, a AS dx, -{SIN} * b - {COS} AS dy, -{COS} * b + {SIN} AS dz FROM r),
      k AS (SELECT *, CASE surface WHEN 'floor' THEN (0 - 12) / dz WHEN 'front_wall' THEN (0 - 40) / dy WHEN 'back_wall' THEN (32 - 40) / dy WHEN 'left_wall' THEN (0 - 10.5) / nullif(dx, 0) ELSE (21 - 10.5) / nullif(dx, 0) END AS s FROM d),
      q AS (SELECT *, 10.5 + s * dx AS qx, 40 + s * dy AS qy, 12 + s * dz AS qz FROM k WHERE s > 0),
      g AS (SELECT *, CASE WHEN surface = 'floor' THEN qx BETWEEN -0.4987 AND 21.4987 AND qy BETWEEN -0.4987 AND 32.4987 WHEN surface IN ('front_wall', 'back_wall') THEN qx BETWEEN -0.4987 AND 21.4987 AND qz >= -0.4987 ELSE qy BETWEEN -0.4987 AND 32.4987 AND qz >= -0.4987 END AS ok FROM q)
      SELECT run_id, track, t, round(qx, 10) + 0.0 AS sx, round(qy, 10) + 0.0 AS sy, round(qz, 10) + 0.0 AS sz FROM g WHERE ok""",
)
def j16_snap(spark, sf):
    cam, p = camera(), [F.col("x_ft"), F.col("y_ft"), F.col("z")]
    rows = contacts(spark, sf).withColumn("p", V.project(cam, *p))
    rows = rows.withColumn("s", J.let(V.ray(cam, F.col("p.u"), F.col("p.v")), lambda d: V.snap(cam, d, F.col("surface")))).filter(V.in_surface(F.col("surface"), F.col("s.x"), F.col("s.y"), F.col("s.z"), 0.4987))
    return rows.select("run_id", "track", "t", *[(F.round(f"s.{c}", 10) + 0.0).alias(f"s{c}") for c in "xyz"])


@register(
    "j19_image_lines",
    """WITH p AS (SELECT run_id, frame, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM track WHERE detected WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
      l AS (SELECT *, sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS n FROM p WHERE x1 IS NOT NULL),
      q AS (SELECT *, (y - y1) / n AS a, (x1 - x) / n AS b, (x * y1 - x1 * y) / n AS c FROM l WHERE n > 1e-9), w AS (SELECT *, a * 0.8 - 0.6 * b AS d FROM q)
      SELECT run_id, frame, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, CASE WHEN abs(d) > 1e-12 THEN round((b * -500 - 0.8 * c) / d, 3) + 0.0 END AS meet_x,
      round(abs(degrees(atan2((x1 - x) * 1 - (y1 - y) * 2, (x1 - x) * 2 + (y1 - y) * 1))), 5) AS turn, round(((x - 3) * (y - 5)) / ((y - 3) * (x - 5)), 5) AS cross_ratio FROM w""",
)
def j19(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy("frame")
    p = seen(spark, sf).select("run_id", "frame", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).filter("x1 IS NOT NULL")
    rows = p.withColumn("l", V.line_through(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))).filter("l IS NOT NULL")
    other = F.struct(F.lit(0.6).alias("a"), F.lit(0.8).alias("b"), F.lit(-500.0).alias("c"))
    met = V.meet(F.col("l"), other)
    turn = V.direction_delta(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.lit(2.0), F.lit(1.0))
    return rows.select(
        "run_id", "frame", (F.round("l.a", 6) + 0.0).alias("a"), (F.round("l.b", 6) + 0.0).alias("b"), (F.round(met["x"], 3) + 0.0).alias("meet_x"), F.round(turn, 5).alias("turn"),
        F.round(V.cross_ratio(F.col("x"), F.col("y"), F.lit(3.0), F.lit(5.0)), 5).alias("cross_ratio"),
    )


@register(
    "j19b_surface_distances",
    f"""WITH {CONTACTS} SELECT run_id, track, t, round(z, 6) AS floor, round(y_ft, 6) AS wall, round(least(x_ft, 21 - x_ft), 6) AS side, CASE WHEN z <= y_ft AND z <= least(x_ft, 21 - x_ft) THEN 'floor' WHEN y_ft <= least(x_ft, 21 - x_ft) THEN 'wall' ELSE 'side' END AS nearest,
      x_ft BETWEEN -2 AND 23 AND y_ft BETWEEN -2 AND 34 AND z BETWEEN -2 AND 17 AS plausible FROM p""",
)
def j19b(spark, sf):
    p = [F.col("x_ft"), F.col("y_ft"), F.col("z")]
    rows = contacts(spark, sf).withColumns({"d": V.surface_distances(*p), "plausible": V.in_court(*p)})
    return rows.select("run_id", "track", "t", *[F.round(f"d.{c}", 6).alias(c) for c in ("floor", "wall", "side")], "d.nearest", "plausible")


@register(
    "j14_streaks",
    """WITH q AS (SELECT run_id, frame // 20 AS part, frame, x, y, row_number() OVER (PARTITION BY run_id, frame // 20 ORDER BY frame) AS i FROM track WHERE detected),
      d AS (SELECT a.run_id, a.part, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS n FROM q a JOIN q b ON a.run_id = b.run_id AND a.part = b.part AND a.i < b.i
        QUALIFY row_number() OVER (PARTITION BY a.run_id, a.part ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) DESC, a.i, b.i) = 1),
      w AS (SELECT d.run_id, d.part, n, degrees(atan2(by_ - ay, bx - ax)) AS angle, 2 * max(abs(-(q.y - ay) * (bx - ax) / n + (q.x - ax) * (by_ - ay) / n)) AS width FROM d JOIN q ON q.run_id = d.run_id AND q.part = d.part WHERE n > 0 GROUP BY ALL),
      b AS (SELECT run_id, part, max(x) - min(x) AS w, max(y) - min(y) AS h FROM q GROUP BY run_id, part)
      SELECT b.run_id, b.part, round(n, 5) AS length, round(width, 5) AS width, round(angle, 5) AS angle, round(b.w, 5) AS box_w, round(b.h, 5) AS box_h FROM b LEFT JOIN w ON w.run_id = b.run_id AND w.part = b.part""",
)
def j14(spark, sf):
    p = seen(spark, sf).groupBy("run_id", F.floor(F.col("frame") / 20).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("p"))
    rows = p.withColumns({"s": V.streak(F.col("p")), "b": V.box_of(F.col("p"))})
    return rows.select("run_id", "part", *[F.round(f"s.{c}", 5).alias(c) for c in ("length", "width", "angle")], F.round("b.w", 5).alias("box_w"), F.round("b.h", 5).alias("box_h"))


@register(
    "j18_screen_box",
    """SELECT run_id, frame, round(100 + x / 1100 * 800, 6) AS sx, round(50 + (1 - y / 1100 - height / 100) * 450, 6) AS sy, round((400 - width * least(400 / width, 300 / height)) / 2, 6) AS fx FROM track WHERE detected""",
)
def j18(spark, sf):
    t = seen(spark, sf)
    box = V.screen_box(F.col("x") / 1100, F.col("y") / 1100, F.col("width") / 100, F.col("height") / 100, F.lit(100.0), F.lit(50.0), F.lit(800.0), F.lit(450.0))
    fit = V.fitted(F.col("width"), F.col("height"), F.lit(400.0), F.lit(300.0))
    return fixed(t, sx=box["x"], sy=box["y"], fx=fit["x"])
