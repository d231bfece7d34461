"""Queries over sessions, islands and sequential state (G, E16, E17, F22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import sessions as S
from . import bindings as B


def front(spark: SparkSession, sf: str) -> DataFrame:
    return B.hits(spark, sf).filter(C.front_wall(F.col("event_type")))


def rally_hits(spark: SparkSession, sf: str) -> DataFrame:
    f = front(spark, sf)
    return S.numbered(S.segment(f, S.adaptive_gap(f)))


def per_rally(spark: SparkSession, sf: str) -> DataFrame:
    return S.rallies(rally_hits(spark, sf))


@register(
    "g01_split_tracks",
    """SELECT run_id, track_no, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM (
      SELECT *, 1 + sum(CASE WHEN gap > 3 OR hypot_ / gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS track_no FROM (
      SELECT *, frame - lag(frame) OVER w AS gap, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS hypot_ FROM track WHERE detected WINDOW w AS (PARTITION BY run_id ORDER BY frame)))
      GROUP BY run_id, track_no""",
)
def g01(spark, sf):
    return S.split_tracks(B.track(spark, sf).filter("detected")).groupBy("run_id", "track_no").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@register("g02_adaptive_gap", "SELECT run_id, round(threshold, 6) AS threshold, CASE WHEN run_id IN (SELECT run_id FROM pairs WHERE high >= 4 AND high >= 1.75 * low) THEN 'adaptive' ELSE 'default' END AS method FROM split")
def g02(spark, sf):
    return S.adaptive_gap(front(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@register(
    "g02_adaptive_gap_strict",
    """SELECT r.run_id, round(coalesce(p.threshold, 5.0), 6) AS threshold FROM (SELECT DISTINCT run_id FROM front) r LEFT JOIN (
      SELECT run_id, (low + high) / 2 AS threshold FROM pairs WHERE high >= 4 AND high >= 2 * low QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY high / low DESC, low) = 1) p USING (run_id)""",
)
def g02_strict(spark, sf):
    return S.adaptive_gap(front(spark, sf), ratio=2.0).select("run_id", F.round("threshold", 6).alias("threshold"))


@register(
    "g03_cluster_times",
    """SELECT run_id, c AS cluster, count(*) AS n, round(min(t), 6) AS start_t, round(max(t), 6) AS end_t FROM (
      SELECT *, 1 + sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS c FROM (
      SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY frame) AS gap FROM front)) GROUP BY run_id, c""",
)
def g03(spark, sf):
    c = S.segment(front(spark, sf), 5.0, inclusive=False)
    return c.groupBy("run_id", F.col("rally_number").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("start_t"), F.round(F.max("t"), 6).alias("end_t"))


@register(
    "g04_rallies",
    "SELECT run_id, rally_number, start_frame, end_frame, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t, n_hits, serve_call, last_call FROM rallies",
)
def g04(spark, sf):
    return per_rally(spark, sf).withColumn("start_t", F.round("start_t", 6)).withColumn("end_t", F.round("end_t", 6))


@register("f22_hit_sequences", "SELECT run_id, frame, sequence, rally_number, rally_hit_sequence FROM rally_hits")
def f22(spark, sf):
    return rally_hits(spark, sf).select("run_id", "frame", "sequence", "rally_number", "rally_hit_sequence")


MOTION = """m AS (SELECT run_id, frame, t, y AS energy FROM track WHERE detected), th AS (SELECT run_id, quantile_cont(energy, 0.5) + 100 AS threshold FROM m GROUP BY run_id),
  sp AS (SELECT run_id, min(t) AS s, max(t) AS e, count(*) AS n FROM (SELECT *, sum(ch) OVER (PARTITION BY run_id ORDER BY frame) AS span FROM (
    SELECT *, CASE WHEN on_ IS DISTINCT FROM lag(on_) OVER (PARTITION BY run_id ORDER BY frame) THEN 1 ELSE 0 END AS ch FROM (
    SELECT m.*, energy > threshold AS on_ FROM m JOIN th USING (run_id)))) WHERE on_ GROUP BY run_id, span)"""


def spans(spark, sf):
    m = B.track(spark, sf).filter("detected").select("run_id", "frame", "t", F.col("y").alias("energy"))
    return S.active_spans(m, m.groupBy("run_id").agg((F.median("energy") + 100).alias("threshold")))


@register("g05_active_spans", f"WITH {MOTION} SELECT run_id, round(s, 6) AS start, round(e, 6) AS \"end\", n FROM sp")
def g05(spark, sf):
    return spans(spark, sf).select("run_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


MERGED = """mg AS (SELECT run_id, min(s) AS s, max(e) AS e, count(*) AS parts FROM (SELECT *, sum(CASE WHEN s - reach > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e) AS i FROM (
    SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)) GROUP BY run_id, i)"""


@register("g06_bridge_spans", f"WITH {MOTION}, {MERGED} SELECT run_id, round(s, 6) AS start, round(e, 6) AS \"end\", parts FROM mg")
def g06(spark, sf):
    return S.merge_intervals(spans(spark, sf), 0.1).select("run_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "parts")


@register(
    "g07_refine_windows",
    """WITH b AS (SELECT run_id, min(frame) AS low, max(frame) AS high FROM hits GROUP BY run_id), x AS (SELECT run_id, greatest(frame - 2, low) AS s, least(frame + 2, high) AS e FROM hits JOIN b USING (run_id) WHERE event_type = 'floor')
      SELECT run_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM (SELECT *, sum(CASE WHEN s - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e) AS i FROM (
      SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)) GROUP BY run_id, i""",
)
def g07(spark, sf):
    return S.refine_windows(B.bounded(B.hits(spark, sf)).filter("event_type = 'floor'"), 2, F.col("first_frame"), F.col("last_frame"))


@register("g08_clamp_timeline")
def g08(spark, sf):
    merged = S.merge_intervals(spans(spark, sf), 0.1).withColumn("n", F.col("parts"))
    return S.clamp_timeline(merged, 1e6).select("run_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n", "confidence")


@register(
    "g09_serve_faults",
    """SELECT run_id, frame, sum(CASE WHEN open_ = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS rally_number_split FROM (
      SELECT run_id, frame, coalesce(sum(CASE WHEN call = 'OUT' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, rally_number ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_ FROM rally_hits)""",
)
def g09(spark, sf):
    return S.serve_faults(rally_hits(spark, sf)).select("run_id", "frame", "rally_number_split")


CHAIN = """f AS (SELECT *, CASE WHEN serve_call = 'OUT' OR (last_call = 'OUT' AND n_hits % 2 = 1) OR (last_call = 'IN' AND n_hits % 2 = 0) THEN 1 ELSE 0 END AS flip FROM rallies),
  ch AS (SELECT *, CAST(1 + coalesce(sum(flip) OVER (PARTITION BY run_id ORDER BY rally_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS INT) AS server FROM f),
  cw AS (SELECT *, CASE WHEN serve_call = 'OUT' OR last_call IS NOT NULL THEN CASE WHEN flip = 1 THEN 3 - server ELSE server END END AS winner,
    CASE WHEN serve_call = 'OUT' THEN 'serve_out' WHEN last_call = 'OUT' THEN 'last_out' WHEN last_call = 'IN' THEN 'last_in' END AS winner_reason FROM ch)"""


def chained(spark, sf):
    return S.server_chain(per_rally(spark, sf))


@register("g10_server_chain", f"WITH {CHAIN} SELECT run_id, rally_number, server, winner, winner_reason FROM cw")
def g10(spark, sf):
    return chained(spark, sf).select("run_id", "rally_number", "server", "winner", "winner_reason")


@register(
    "e17_running_score",
    f"WITH {CHAIN} SELECT run_id, rally_number, sum(CASE WHEN winner = 1 THEN 1 ELSE 0 END) OVER w AS score_1, sum(CASE WHEN winner = 2 THEN 1 ELSE 0 END) OVER w AS score_2 FROM cw WINDOW w AS (PARTITION BY run_id ORDER BY rally_number)",
)
def e17(spark, sf):
    return S.running_score(chained(spark, sf)).select("run_id", "rally_number", "score_1", "score_2")


@register(
    "g11_backfill_winners",
    f"""WITH {CHAIN}, o AS (SELECT *, lead(CASE WHEN start_frame % 3 = 0 THEN CAST(start_frame % 2 + 1 AS INT) END) OVER (PARTITION BY run_id ORDER BY rally_number) AS ns FROM cw)
      SELECT run_id, rally_number, coalesce(winner, ns) AS winner_final, CASE WHEN winner IS NOT NULL THEN 'calls' WHEN ns IS NOT NULL THEN 'next_serve' END AS winner_source, winner = ns AS agrees FROM o""",
)
def g11(spark, sf):
    c = chained(spark, sf)
    seen = c.filter("start_frame % 3 = 0").select("run_id", "rally_number", (F.col("start_frame") % 2 + 1).cast("int").alias("observed_server"))
    return S.backfill_winners(c, seen).select("run_id", "rally_number", "winner_final", "winner_source", "agrees")


@register("g15_cadence", "SELECT run_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS n FROM track WHERE detected) WHERE (n - 1) % 4 = 0")
def g15(spark, sf):
    return S.cadence(B.track(spark, sf).filter("detected"), 4).select("run_id", "frame")


@register("g16_first_observation", "SELECT run_id, frame, event_id FROM (SELECT run_id, frame // 2 AS frame, event_id, row_number() OVER (PARTITION BY run_id, frame // 2 ORDER BY event_id) AS n FROM hits) WHERE n = 1")
def g16(spark, sf):
    h = B.hits(spark, sf).select("run_id", F.floor(F.col("frame") / 2).alias("frame"), "event_id", F.col("event_id").alias("seq"))
    return S.first_observation(h).select("run_id", "frame", "event_id")


#: A greedy fold as SQL: walk each run's candidates by rank, carrying the list of kept frames.
NMS = """WITH RECURSIVE r AS (SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY speed_before DESC, event_id) AS i FROM hits),
  s AS (SELECT run_id, i, [frame] AS kept FROM r WHERE i = 1
    UNION ALL SELECT r.run_id, r.i, CASE WHEN len(list_filter(s.kept, lambda k: abs(k - r.frame) < 5)) > 0 OR len(s.kept) >= 8 THEN s.kept ELSE list_append(s.kept, r.frame) END FROM s JOIN r ON r.run_id = s.run_id AND r.i = s.i + 1),
  z AS (SELECT run_id, kept FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC) = 1)
  SELECT run_id, CAST(pos - 1 AS INT) AS rank, kept[pos] AS frame FROM (SELECT run_id, kept, unnest(range(1, len(kept) + 1)) AS pos FROM z)"""


@register("g17_suppress_peaks", NMS)
def g17(spark, sf):
    h = B.hits(spark, sf).select("run_id", "frame", F.col("speed_before").alias("score"), F.col("event_id").alias("seq"))
    return S.suppress_peaks(h, 5, 8)


THIN = """WITH RECURSIVE r AS (SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM hits WHERE event_type = 'wall'),
  s AS (SELECT run_id, i, frame AS last, true AS keep, frame FROM r WHERE i = 1
    UNION ALL SELECT r.run_id, r.i, CASE WHEN r.frame - s.last >= 4 THEN r.frame ELSE s.last END, r.frame - s.last >= 4, r.frame FROM s JOIN r ON r.run_id = s.run_id AND r.i = s.i + 1)
  SELECT run_id, frame FROM s WHERE keep"""


@register("g21_thin_bursts", THIN)
def g21(spark, sf):
    return S.thin_bursts(B.hits(spark, sf).filter("event_type = 'wall'").select("run_id", "frame"), 4)


CHUNK = """WITH RECURSIVE r AS (SELECT run_id, frame, x, y, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM track WHERE detected),
  s AS (SELECT run_id, i, frame, x, y, frame AS lf, x AS lx, y AS ly, true AS ok FROM r WHERE i = 1
    UNION ALL SELECT run_id, i, frame, x, y, CASE WHEN ok THEN frame ELSE lf END, CASE WHEN ok THEN x ELSE lx END, CASE WHEN ok THEN y ELSE ly END, ok FROM (
      SELECT r.*, s.lf, s.lx, s.ly, sqrt(power(r.x - s.lx, 2) + power(r.y - s.ly, 2)) <= 90 + 55 * (r.frame - s.lf) AS ok FROM s JOIN r ON r.run_id = s.run_id AND r.i = s.i + 1))
  SELECT run_id, frame FROM s WHERE ok"""


@register("g13_plausible_chunks", CHUNK)
def g13(spark, sf):
    t = B.track(spark, sf).filter("detected").select("run_id", "frame", "x", "y")
    return S.plausible_chunks(t, 90.0, 55.0).select("run_id", "frame")


@register("g13_front_wall_chunks")
def g13_chunks(spark, sf):
    t = B.track(spark, sf).filter("detected")
    score = F.when(F.col("height") > 3, F.col("confidence"))
    return S.wall_chunks(t.select("run_id", "frame", "x", "y", F.col("y").between(200, 800).alias("inside"), score.alias("score")), 90.0, 55.0)


@register("g20_suppress_boxes")
def g20(spark, sf):
    t = B.track(spark, sf).filter("detected")
    boxes = t.select("run_id", F.floor(F.col("frame") / 30).alias("part"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 300).alias("x1"), (F.col("y") + 300).alias("y1"), F.col("confidence").alias("score"), F.col("frame").alias("seq"))
    return S.suppress_boxes(boxes, ["run_id", "part"], 0.3)
