"""Queries over trajectory windows (F, C12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import sessions as S
from ..operators import trajectory as T
from . import bindings as B


def seen(spark, sf):
    return B.track(spark, sf).filter("detected")


def rounded(df, *names, digits=5):
    return df.withColumns({n: F.round(n, digits) for n in names})


@register(
    "f01_smooth_rows",
    """WITH d AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id) AS n, first_value(y) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
      last_value(y) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM track WHERE detected WINDOW w AS (PARTITION BY run_id ORDER BY frame))
      SELECT run_id, frame, round(CASE WHEN n >= 4 THEN (sum(y) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) + a * greatest(0, 2 - (i - 1)) + z * greatest(0, 1 - (n - i))) / 4 ELSE y END, 5) AS smooth FROM d""",
)
def f01(spark, sf):
    return rounded(T.smooth_rows(seen(spark, sf), "y", 4, "smooth"), "smooth").select("run_id", "frame", "smooth")


@register("f02_smooth_time", "SELECT run_id, track, t, round(avg(x_ft) OVER (PARTITION BY run_id, track ORDER BY t RANGE BETWEEN 0.6 PRECEDING AND 0.6 FOLLOWING), 5) AS smooth FROM samples")
def f02(spark, sf):
    return rounded(T.smooth_time(B.samples(spark, sf), "x_ft", 0.6, ["run_id", "track"], "smooth"), "smooth").select("run_id", "track", "t", "smooth")


TR = """tr AS (SELECT *, 1 + sum(CASE WHEN g > 4 OR h / g > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS track_no FROM (
  SELECT *, frame - lag(frame) OVER w AS g, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS h FROM track WHERE detected WINDOW w AS (PARTITION BY run_id ORDER BY frame)))"""
KIN = f"""{TR}, kin AS (SELECT *, sqrt(power(vx1 - vx0, 2) + power(vy1 - vy0, 2)) AS dv, (vx0 * vx1 + vy0 * vy1) / nullif(sqrt(vx0 * vx0 + vy0 * vy0) * sqrt(vx1 * vx1 + vy1 * vy1), 0) AS cs FROM (
  SELECT *, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS vx0, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS vy0, (lead(x) OVER w - x) / (lead(t) OVER w - t) AS vx1, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS vy1
  FROM tr WINDOW w AS (PARTITION BY run_id, track_no ORDER BY frame)))"""


def tracks(spark, sf):
    return S.split_tracks(seen(spark, sf), 4, 400.0)


@register("f04_kinematics", f"WITH {KIN} SELECT run_id, frame, round(dv, 3) AS dv, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, cs)))), 3) AS turn FROM kin WHERE dv IS NOT NULL AND cs IS NOT NULL")
def f04(spark, sf):
    return rounded(T.kinematics(tracks(spark, sf)), "dv", "turn", digits=3).filter("dv IS NOT NULL AND turn IS NOT NULL").select("run_id", "frame", "dv", "turn")


@register(
    "f05_bridge_candidates",
    f"""WITH {KIN}, en AS (SELECT run_id, track_no, min(frame) AS ff, max(frame) AS lf, min(t) AS ft, max(t) AS lt, arg_min(coalesce(vx1, 1e99), frame) AS ix, arg_min(coalesce(vy1, 1e99), frame) AS iy, arg_max(coalesce(vx0, 1e99), frame) AS ox, arg_max(coalesce(vy0, 1e99), frame) AS oy FROM kin GROUP BY run_id, track_no),
      pr AS (SELECT *, lag(lf) OVER w AS prev_frame, lag(lt) OVER w AS pt, lag(ox) OVER w AS px, lag(oy) OVER w AS py FROM en WINDOW w AS (PARTITION BY run_id ORDER BY track_no))
      SELECT run_id, prev_frame, ff AS first_frame, round(CASE WHEN ix < 1e98 AND px < 1e98 THEN sqrt(power(ix - px, 2) + power(iy - py, 2)) END, 3) AS dv FROM pr WHERE ft - pt > 0 AND ft - pt <= 0.5""",
)
def f05(spark, sf):
    return rounded(T.bridge_candidates(tracks(spark, sf)), "dv", digits=3)


@register(
    "f06_context",
    """SELECT a.run_id, a.frame, coalesce(max(b.y) FILTER (WHERE b.frame = a.frame - 1), 0) AS y_m1, coalesce(max(b.y) FILTER (WHERE b.frame = a.frame), 0) AS y_p0, coalesce(max(b.y) FILTER (WHERE b.frame = a.frame + 1), 0) AS y_p1,
      max(b.y) - min(b.y) AS y_span, round(avg(b.y), 5) AS y_mean FROM track a JOIN track b ON b.run_id = a.run_id AND b.frame BETWEEN a.frame - 1 AND a.frame + 1 AND b.detected WHERE a.detected GROUP BY a.run_id, a.frame""",
)
def f06(spark, sf):
    return rounded(T.context(seen(spark, sf), 1, ["y"]), "y_mean")


@register(
    "f07_neighbourhood",
    """WITH s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS st FROM track WHERE detected WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
      n AS (SELECT run_id, frame, count(*) OVER w AS near, sqrt(power(max(x) OVER w - min(x) OVER w, 2) + power(max(y) OVER w - min(y) OVER w, 2)) AS span, sum(st) OVER w - first_value(st) OVER w AS path FROM s
        WINDOW w AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING))
      SELECT run_id, frame, near, round(span, 3) AS span, round(path, 3) AS path, near >= 4 AND span < 12 AND path < 18 AS stationary FROM n""",
)
def f07(spark, sf):
    return rounded(T.neighbourhood(seen(spark, sf), 8), "span", "path", digits=3).select("run_id", "frame", "near", "span", "path", "stationary")


@register(
    "f10_fill_gaps",
    """WITH a AS (SELECT *, last_value(CASE WHEN detected THEN frame END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS p, first_value(CASE WHEN detected THEN frame END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM track),
      b AS (SELECT *, NOT detected AND n - p - 1 <= 6 AND sum(CASE WHEN detected THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, p, n) = n - p - 1 AS ok FROM a)
      SELECT b.run_id, b.frame, coalesce(ok, false) AS filled, round(CASE WHEN ok THEN l.x + (r.x - l.x) * ((b.frame - p)::DOUBLE / (n - p)) ELSE b.x END, 7) AS fx, CASE WHEN ok THEN least(l.confidence, r.confidence) ELSE b.confidence END AS fc
      FROM b LEFT JOIN track l ON l.run_id = b.run_id AND l.frame = p LEFT JOIN track r ON r.run_id = b.run_id AND r.frame = n""",
)
def f10(spark, sf):
    return rounded(T.fill_gaps(B.track(spark, sf)), "fx", digits=7).select("run_id", "frame", "filled", "fx", "fc")


@register(
    "f11_slopes",
    """SELECT run_id, frame, round(regr_slope(y, frame::DOUBLE) OVER b, 5) + 0.0 AS y_before, round(regr_slope(y, frame::DOUBLE) OVER a, 5) + 0.0 AS y_after FROM track WHERE detected
      WINDOW b AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING)
      QUALIFY count(*) OVER b > 1 AND count(*) OVER a > 1""",
)
def f11(spark, sf):
    s = rounded(T.slopes(seen(spark, sf), 6).filter("n_before > 1 AND n_after > 1"), "y_before", "y_after")
    return s.select("run_id", "frame", (F.col("y_before") + 0.0).alias("y_before"), (F.col("y_after") + 0.0).alias("y_after"))


@register(
    "f13_line_valleys",
    """WITH d AS (SELECT *, least(abs(0.1 * x - y + 200) / sqrt(1.01), abs(-0.05 * x - y + 700) / sqrt(1.0025)) AS dist FROM track WHERE detected), v AS (SELECT *, lag(dist) OVER w AS a, lead(dist) OVER w AS b FROM d WINDOW w AS (PARTITION BY run_id ORDER BY frame))
      SELECT run_id, frame, round(dist, 7) AS distance FROM v WHERE dist < a AND dist < b AND dist <= 80""",
)
def f13(spark, sf):
    return rounded(T.line_valleys(seen(spark, sf), [(0.1, 200.0), (-0.05, 700.0)]), "distance", digits=7).select("run_id", "frame", "distance")


@register("f14_split_fit")
def f14(spark, sf):
    return T.split_fit(seen(spark, sf))


@register(
    "f16_merge_candidates",
    """WITH c AS (SELECT run_id, frame, 'a' AS source, k % 2 = 0 AS requires, y AS score, k AS value, event_id AS seq FROM hits WHERE k % 3 > 0 UNION ALL SELECT run_id, frame, 'b', k % 5 > 0, x, k + 1, event_id FROM hits WHERE k % 4 > 0)
      SELECT run_id, frame, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, bool_and(requires) AS requires, round(max(score), 6) AS score, arg_min(value, struct_pack(q := seq, s := source)) AS value FROM c GROUP BY run_id, frame""",
)
def f16(spark, sf):
    h = B.hits(spark, sf)
    pick = lambda cond, name, req, score, value: h.filter(cond).select("run_id", "frame", F.lit(name).alias("source"), F.expr(req).alias("requires"), F.col(score).alias("score"), F.expr(value).alias("value"), F.col("event_id").alias("seq"))
    return rounded(T.merge_candidates(pick("k % 3 > 0", "a", "k % 2 = 0", "y", "k"), pick("k % 4 > 0", "b", "k % 5 > 0", "x", "k + 1")), "score", digits=6)


@register("f18_sliding_rms", "SELECT run_id, frame, round(sqrt(avg(y * y) OVER (PARTITION BY run_id ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), 6) AS rms FROM hits QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY frame) % 5 = 0")
def f18(spark, sf):
    w = T.by_frame()
    h = B.hits(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("rms", F.sqrt(F.avg(F.col("y") * F.col("y")).over(w.rowsBetween(-11, 0))))
    return rounded(h.filter("i % 5 = 0"), "rms", digits=6).select("run_id", "frame", "rms")


@register(
    "f19_local_maxima",
    """WITH th AS (SELECT run_id, quantile_cont(y, 0.5) + 0.02 AS threshold FROM hits GROUP BY run_id), n AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM hits WINDOW w AS (PARTITION BY run_id ORDER BY frame))
      SELECT n.run_id, frame, round(y, 6) AS y FROM n JOIN th ON th.run_id = n.run_id WHERE y > threshold AND y >= a AND y >= b""",
)
def f19(spark, sf):
    h = B.hits(spark, sf).select("run_id", "frame", "y")
    return rounded(T.local_maxima(h, "y", h.groupBy("run_id").agg((F.median("y") + 0.02).alias("threshold"))), "y", digits=6)


@register("f21_event_gaps", "SELECT run_id, frame, round(t - lag(t) OVER w, 6) AS gap_prev, round(lead(t) OVER w - t, 6) AS gap_next FROM front WINDOW w AS (PARTITION BY run_id ORDER BY frame)")
def f21(spark, sf):
    return rounded(T.event_gaps(B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).select("run_id", "frame", "t")), "gap_prev", "gap_next", digits=6).drop("t")
