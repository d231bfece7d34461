"""Queries over joins (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import joins as J
from . import bindings as B
from .session_queries import per_rally, rally_hits


def walls(spark, sf):
    return B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).select("run_id", "frame", "t", "event_id")


def peaks(spark, sf, kind="floor"):
    return B.hits(spark, sf).filter(f"event_type = '{kind}'").select("run_id", F.col("t").alias("peak_t"), F.col("event_id").alias("peak_id"), F.col("y").alias("peak_score"))


@register(
    "d01_nearest_within_tolerance",
    """SELECT l.run_id, l.frame, r.event_id AS peak_id, round(abs(l.t - r.t), 6) AS offset_t FROM hits l LEFT JOIN (
      SELECT l.run_id, l.event_id AS lid, r.event_id, r.t FROM hits l JOIN hits r ON l.run_id = r.run_id AND abs(l.t - r.t) <= 6 AND r.event_type = 'floor' AND l.event_type = 'wall'
      QUALIFY row_number() OVER (PARTITION BY l.run_id, l.event_id ORDER BY abs(l.t - r.t), r.event_id) = 1) r ON r.run_id = l.run_id AND r.lid = l.event_id WHERE l.event_type = 'wall'""",
)
def d01(spark, sf):
    n = J.nearest(walls(spark, sf), peaks(spark, sf), "t", "peak_t", 6.0, "event_id", "peak_id")
    return n.select("run_id", "frame", "peak_id", F.round(F.abs(F.col("t") - F.col("peak_t")), 6).alias("offset_t"))


GREEDY = """WITH RECURSIVE l AS (SELECT run_id, event_id AS id, CAST({at} AS DOUBLE) AS ap, row_number() OVER (PARTITION BY run_id ORDER BY {at}, event_id) AS i FROM hits WHERE event_type = '{left}'),
  r AS (SELECT run_id, event_id AS id, CAST({at} AS DOUBLE) AS ap FROM hits WHERE event_type = '{right}'),
  rr AS (SELECT run_id, list(struct_pack(ap := ap, id := id) ORDER BY ap, id) AS r FROM r GROUP BY run_id),
  c AS (SELECT l.*, coalesce(list_transform(list_sort(list_transform(list_filter(rr.r, lambda y: abs(y.ap - l.ap) <= {tol}), lambda y: struct_pack(d := abs(y.ap - l.ap), ap := y.ap, id := y.id))), lambda z: z), []) AS cand FROM l LEFT JOIN rr USING (run_id)),
  s AS (SELECT run_id, i, id, cand[1].id AS m, cand[1].d AS d, [cand[1].id] AS used FROM c WHERE i = 1
    UNION ALL SELECT c.run_id, c.i, c.id, f.m.id, f.m.d, list_append(s.used, f.m.id) FROM s JOIN c ON c.run_id = s.run_id AND c.i = s.i + 1, LATERAL (SELECT list_filter(c.cand, lambda z: NOT coalesce(list_contains(s.used, z.id), false))[1] AS m) f)
  SELECT run_id, id AS left_id, m AS right_id, round(d, 6) AS distance FROM s"""


def greedy(spark, sf, at, left, right, tol):
    side = lambda k: B.hits(spark, sf).filter(f"event_type = '{k}'").select("run_id", F.col(at).cast("double").alias("at"), F.col("event_id").alias("id"))
    return J.greedy_match(side(left), side(right), tol).withColumn("distance", F.round("distance", 6))


@register("d02_greedy_frame_match", GREEDY.format(at="frame", left="wall", right="racket", tol=3))
def d02(spark, sf):
    return greedy(spark, sf, "frame", "wall", "racket", 3.0)


@register("d03_greedy_time_match", GREEDY.format(at="t", left="floor", right="racket", tol=12))
def d03(spark, sf):
    return greedy(spark, sf, "t", "floor", "racket", 12.0)


def rally_spans(spark, sf):
    return per_rally(spark, sf).select("run_id", "rally_number", F.col("start_t").alias("start"), F.col("end_t").alias("end"))


@register(
    "d04_first_interval",
    """SELECT h.run_id, h.frame, r.rally_number FROM hits h JOIN rallies r ON h.run_id = r.run_id AND h.t BETWEEN r.start_t AND r.end_t
      QUALIFY row_number() OVER (PARTITION BY h.run_id, h.frame ORDER BY r.start_t, r.end_t) = 1""",
)
def d04(spark, sf):
    return J.first_interval(B.hits(spark, sf), rally_spans(spark, sf), "t", ["frame"]).select("run_id", "frame", "rally_number")


@register("d05_in_any_interval", "SELECT run_id, frame FROM hits h WHERE event_type <> 'wall' AND EXISTS (SELECT 1 FROM rallies r WHERE r.run_id = h.run_id AND h.t BETWEEN r.start_t AND r.end_t)")
def d05(spark, sf):
    return J.in_any_interval(B.hits(spark, sf).filter("event_type <> 'wall'"), rally_spans(spark, sf), "t").select("run_id", "frame")


@register(
    "d06_rally_lookup",
    """WITH p AS (SELECT h.run_id, h.frame, h.t, CASE WHEN h.frame % 2 = 0 THEN rh.rally_number END AS k FROM hits h LEFT JOIN rally_hits rh ON rh.run_id = h.run_id AND rh.frame = h.frame),
      a AS (SELECT p.run_id, p.frame, r.rally_number FROM p JOIN rallies r ON p.run_id = r.run_id AND k IS NULL AND p.t BETWEEN r.start_t AND r.end_t QUALIFY row_number() OVER (PARTITION BY p.run_id, p.frame ORDER BY r.start_t, r.end_t) = 1),
      b AS (SELECT p.run_id, p.frame, r.rally_number FROM p JOIN rallies r ON p.run_id = r.run_id AND k IS NULL AND p.frame BETWEEN r.start_frame AND r.end_frame QUALIFY row_number() OVER (PARTITION BY p.run_id, p.frame ORDER BY r.start_frame, r.end_frame) = 1)
      SELECT p.run_id, p.frame, coalesce(k, a.rally_number, b.rally_number) AS rally_found FROM p LEFT JOIN a USING (run_id, frame) LEFT JOIN b USING (run_id, frame)""",
)
def d06(spark, sf):
    known = rally_hits(spark, sf).filter("frame % 2 = 0").select("run_id", "frame", F.col("rally_number").alias("k"))
    points = B.hits(spark, sf).select("run_id", "frame", "t").join(known, ["run_id", "frame"], "left")
    return J.rally_lookup(points, per_rally(spark, sf), "k").select("run_id", "frame", "rally_found")


@register(
    "d07_overlap_hull",
    """WITH f AS (SELECT run_id, min(t) AS s, max(t) AS e FROM (SELECT *, frame // 6 AS b FROM hits) GROUP BY run_id, b)
      SELECT r.run_id, round(start_t, 6) AS start, round(end_t, 6) AS "end", round(least(start_t, min(s)), 6) AS hull_start, round(greatest(end_t, max(e)), 6) AS hull_end, count(*) AS n
      FROM rallies r JOIN f ON f.run_id = r.run_id AND start_t <= e AND s <= end_t GROUP BY r.run_id, start_t, end_t""",
)
def d07(spark, sf):
    blocks = B.hits(spark, sf).groupBy("run_id", F.floor(F.col("frame") / 6).alias("b")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    o = J.overlapping(rally_spans(spark, sf), blocks)
    return o.select("run_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "hull_start", "hull_end")], "n")


@register(
    "d08_unclaimed_peaks",
    "SELECT run_id, event_id AS peak_id FROM hits p WHERE event_type = 'floor' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.run_id = p.run_id AND h.event_type = 'wall' AND abs(h.t - p.t) <= 4)",
)
def d08(spark, sf):
    return J.unclaimed(peaks(spark, sf), walls(spark, sf), "peak_t", "t", 4.0, "peak_id").select("run_id", "peak_id")


@register("d09_frame_lookup", "SELECT h.run_id, h.frame, p.event_id AS previous_id FROM hits h LEFT JOIN hits p ON p.run_id = h.run_id AND p.frame = h.frame - 2 AND p.event_type = 'wall'")
def d09(spark, sf):
    other = walls(spark, sf).select("run_id", (F.col("frame") + 2).alias("frame"), F.col("event_id").alias("previous_id"))
    return B.hits(spark, sf).select("run_id", "frame").join(other, ["run_id", "frame"], "left")


@register(
    "d10_best_run_per_source",
    """WITH b AS (SELECT o_custkey, o_orderkey, count(*) AS n_hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
      SELECT c_custkey, o_orderkey AS run_id, n_hits, o_orderkey IS NULL AS no_run FROM customer LEFT JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n_hits DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""",
)
def d10(spark, sf):
    n = B.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_hits"))
    runs = B.read(spark, sf, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey")
    best = runs.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("n_hits", "o_orderkey")).alias("b")).select("c_custkey", F.col("b.o_orderkey").alias("run_id"), F.col("b.n_hits").alias("n_hits"))
    return B.read(spark, sf, "customer").select("c_custkey").join(best, "c_custkey", "left").withColumn("no_run", F.col("run_id").isNull())


@register(
    "d11_predicted_against_labelled",
    """SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' AND c_acctbal > 0 THEN 1 ELSE 0 END) AS agree, round(sum(CASE WHEN o_orderstatus = 'F' AND c_acctbal > 0 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
)
def d11(spark, sf):
    j = B.read(spark, sf, "orders").join(B.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    agree = F.sum(((F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 0)).cast("long"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), agree.alias("agree"), F.round(agree / F.count("*"), 6).alias("accuracy"))


@register(
    "d12_nearest_detected_frame",
    """WITH q AS (SELECT DISTINCT run_id, frame FROM track WHERE NOT detected), d AS (SELECT run_id, frame AS f FROM track WHERE detected)
      SELECT q.run_id, q.frame, n.f AS found FROM q LEFT JOIN (SELECT q.run_id, q.frame, f FROM q JOIN d ON d.run_id = q.run_id AND abs(f - q.frame) <= 4 QUALIFY row_number() OVER (PARTITION BY q.run_id, q.frame ORDER BY abs(f - q.frame), f) = 1) n USING (run_id, frame)""",
)
def d12(spark, sf):
    t = B.track(spark, sf)
    missing = t.filter("NOT detected").select("run_id", "frame", F.col("frame").cast("double").alias("at")).distinct()
    seen = t.filter("detected").select("run_id", F.col("frame").alias("found"), F.col("frame").cast("double").alias("found_at"))
    return J.nearest(missing, seen, "at", "found_at", 4.0, "frame", "found").select("run_id", "frame", "found")


@register(
    "d13_backward_asof",
    """SELECT h.run_id, h.frame, r.event_id AS before_id FROM hits h LEFT JOIN (SELECT h.run_id, h.event_id AS hid, p.event_id FROM hits h JOIN hits p ON h.event_type = 'wall' AND p.event_type = 'racket' AND p.run_id = h.run_id AND p.t < h.t AND p.t >= h.t - 10
      QUALIFY row_number() OVER (PARTITION BY h.run_id, h.event_id ORDER BY p.t DESC, p.event_id DESC) = 1) r ON r.run_id = h.run_id AND r.hid = h.event_id WHERE h.event_type = 'wall'""",
)
def d13(spark, sf):
    r = peaks(spark, sf, "racket").withColumn("right_seq", F.col("peak_id"))
    return J.backward_asof(walls(spark, sf), r, "t", "peak_t", 10.0, "event_id").select("run_id", "frame", F.col("peak_id").alias("before_id"))


@register(
    "d16_best_by_score_in_window",
    """SELECT w.run_id, w.frame, coalesce(max(p.y), 0) AS best_score, count(p.y) AS n FROM hits w LEFT JOIN hits p ON p.run_id = w.run_id AND p.event_type = 'floor' AND abs(p.frame - w.frame) <= 5 WHERE w.event_type = 'wall' GROUP BY w.run_id, w.frame""",
)
def d16(spark, sf):
    p = B.hits(spark, sf).filter("event_type = 'floor'").select("run_id", F.col("frame").cast("double").alias("pf"), "y")
    w = walls(spark, sf).select("run_id", "frame", F.col("frame").cast("double").alias("f"))
    near = J.band_join(w, p, "f", "pf", 5.0).groupBy("run_id", "frame").agg(F.max("y").alias("best_score"), F.count("*").alias("n"))
    return w.select("run_id", "frame").join(near, ["run_id", "frame"], "left").fillna(0, ["best_score", "n"])


@register("d24_zero_filled_zones", "SELECT r.run_id, z.zone, count(h.frame) AS n FROM (SELECT DISTINCT run_id FROM hits) r CROSS JOIN (SELECT unnest(range(1, 10)) AS zone) z LEFT JOIN hits h ON h.run_id = r.run_id AND h.k % 13 + 1 = z.zone GROUP BY ALL")
def d24(spark, sf):
    n = B.hits(spark, sf).groupBy("run_id", (F.col("k") % 13 + 1).cast("long").alias("zone")).agg(F.count("*").alias("n"))
    return J.dense(n, spark.range(1, 10).withColumnRenamed("id", "zone"), ["run_id"], ["n"])


@register(
    "d25_run_metadata",
    "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
def d25(spark, sf):
    o, c, n, r = (B.read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    who = c.join(place, c.c_nationkey == place.n_nationkey, "left").select("c_custkey", "c_name", "n_name", "r_name")
    return o.join(who, o.o_custkey == who.c_custkey, "left").select("o_orderkey", "c_name", "n_name", "r_name")


@register(
    "d26_wrapped_neighbours",
    """WITH l AS (SELECT run_id, frame FROM hits WHERE event_type = 'signup' OR event_type = 'racket'), a AS (SELECT run_id, min(frame) AS lo, max(frame) AS hi FROM l GROUP BY run_id)
      SELECT h.run_id, h.frame, coalesce((SELECT min(l.frame) FROM l WHERE l.run_id = h.run_id AND l.frame > h.frame), lo, h.frame) AS next_label,
        coalesce((SELECT max(l.frame) FROM l WHERE l.run_id = h.run_id AND l.frame < h.frame), hi, h.frame) AS previous_label FROM hits h LEFT JOIN a ON a.run_id = h.run_id""",
)
def d26(spark, sf):
    h = B.hits(spark, sf)
    return J.neighbours_wrapped(h.filter("event_type = 'racket'"), h.select("run_id", "frame"))


@register("d20_substring_join", "SELECT o_orderkey, max(n_name) AS n_name FROM orders JOIN nation ON contains(o_orderpriority || ' ' || o_orderstatus || ' ' || n_name, '1-URGENT F') AND n_nationkey = o_custkey % 25 GROUP BY o_orderkey")
def d20(spark, sf):
    o, n = B.read(spark, sf, "orders"), B.read(spark, sf, "nation")
    j = o.join(n, (F.col("n_nationkey") == F.col("o_custkey") % 25) & F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "n_name").contains("1-URGENT F"))
    return j.groupBy("o_orderkey").agg(F.max("n_name").alias("n_name"))


@register(
    "e21_match_scores",
    GREEDY.format(at="t", left="floor", right="racket", tol=12).replace(
        "SELECT run_id, id AS left_id, m AS right_id, round(d, 6) AS distance FROM s",
        """SELECT a.run_id, matched, n_left, n_right, round(CASE WHEN n_left + n_right = 0 THEN 1 ELSE 2 * matched::DOUBLE / (n_left + n_right) END, 6) AS f1 FROM (SELECT run_id, count(m) AS matched, count(*) AS n_left FROM s GROUP BY run_id) a
          JOIN (SELECT run_id, count(*) FILTER (WHERE event_type = 'racket') AS n_right FROM hits GROUP BY run_id) b USING (run_id)""",
    ),
)
def e21(spark, sf):
    m = greedy(spark, sf, "t", "floor", "racket", 12.0).groupBy("run_id").agg(F.count("right_id").alias("matched"), F.count("*").alias("n_left"))
    right = B.hits(spark, sf).groupBy("run_id").agg(F.count_if(F.col("event_type") == "racket").alias("n_right"))
    both = F.col("n_left") + F.col("n_right")
    return m.join(right, "run_id").withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("matched"), both), F.lit(1.0)), 6))
