"""Queries over aggregations (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import aggregates as A
from . import bindings as B
from .session_queries import CHAIN, chained, rally_hits

ZONE = f"(CASE WHEN x < 0.21 THEN 0 WHEN x <= 0.79 THEN 1 ELSE 2 END) * 3 + (CASE WHEN y < 0.324 THEN 0 WHEN y < {C.SERVICE_Y}::DOUBLE THEN 1 ELSE 2 END) + 1"


def zone_sql(keys: str, src: str, zone: str, zones: int) -> str:
    return f"""WITH z AS (SELECT {keys}, {zone} AS zone FROM {src}), c AS (SELECT {keys}, zone, count(*) AS n FROM z GROUP BY ALL),
      f AS (SELECT k.*, CAST(l.zone AS INT) AS zone, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {keys} FROM c) k CROSS JOIN (SELECT unnest(range(1, {zones + 1})) AS zone) l LEFT JOIN c USING ({keys}, zone))
      SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {keys}), 1) AS pct, CASE WHEN n > 0 AND row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, zone) <= 3 THEN row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, zone) END AS top FROM f"""


@register("e01_target_zones", zone_sql("run_id", "rally_hits WHERE rally_hit_sequence > 1", ZONE, 9))
def e01(spark, sf):
    h = rally_hits(spark, sf).filter("rally_hit_sequence > 1").select("run_id", C.target_zone(F.col("x"), F.col("y")).alias("zone"))
    return A.zone_summary(h, 9, ["run_id"])


@register("e02_target_zones_by_player", zone_sql("run_id, player", "(SELECT *, rally_hit_sequence % 2 + 1 AS player FROM rally_hits WHERE rally_hit_sequence > 1)", ZONE, 9))
def e02(spark, sf):
    h = rally_hits(spark, sf).filter("rally_hit_sequence > 1").select("run_id", (F.col("rally_hit_sequence") % 2 + 1).alias("player"), C.target_zone(F.col("x"), F.col("y")).alias("zone"))
    return A.zone_summary(h, 9, ["run_id", "player"])


@register("e03_floor_zones", zone_sql("run_id", "samples", "CAST(least(3, greatest(0, floor(y_ft / 32 * 4))) * 3 + least(2, greatest(0, floor(x_ft / 21 * 3))) + 1 AS INT)", 12))
def e03(spark, sf):
    zone = C.grid_cell(F.col("y_ft"), 32.0, 4) * 3 + C.grid_cell(F.col("x_ft"), 21.0, 3) + 1
    return A.zone_summary(B.samples(spark, sf).select("run_id", zone.alias("zone")), 12, ["run_id"])


SHOTS = f"""count(*) AS shots, round(avg({C.OUT_FT}::DOUBLE - y * {C.OUT_FT - C.TIN_FT}::DOUBLE), 8) AS avg_height_ft, round(avg(speed_before), 8) AS avg_speed_in, round(avg(speed_after), 8) AS avg_speed_out,
  round(max(speed_before), 8) AS max_speed, round(count(*) FILTER (WHERE x BETWEEN 0.21 AND 0.79) * 100.0::DOUBLE / count(*), 1) AS centre_pct,
  round(count(*) FILTER (WHERE NOT x BETWEEN 0.21 AND 0.79) * 100.0::DOUBLE / count(*), 1) AS side_pct, count(*) FILTER (WHERE call = 'IN') AS n_in, count(*) FILTER (WHERE call = 'OUT') AS n_out"""


@register("e04_shot_metrics", f"SELECT run_id, {SHOTS} FROM front GROUP BY run_id")
def e04(spark, sf):
    return B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).groupBy("run_id").agg(*A.shot_metrics(8))


@register(
    "e05_error_metrics",
    f"""WITH {CHAIN} SELECT run_id, count(*) FILTER (WHERE winner = 2) AS lost, count(*) FILTER (WHERE winner = 2 AND winner_reason IN ('serve_out', 'last_out')) AS unforced,
      count(*) FILTER (WHERE winner = 2 AND winner_reason = 'last_in') AS forced,
      round(CASE WHEN count(*) FILTER (WHERE winner = 2) > 0 THEN count(*) FILTER (WHERE winner = 2 AND winner_reason IN ('serve_out', 'last_out')) * 100.0::DOUBLE / count(*) FILTER (WHERE winner = 2) END, 1) AS unforced_pct,
      round(avg(end_t - start_t) FILTER (WHERE winner = 1), 6) AS avg_won_length FROM cw GROUP BY run_id""",
)
def e05(spark, sf):
    c = chained(spark, sf)
    return c.groupBy("run_id").agg(*A.error_metrics(c, F.lit(1)))


@register("e06_last_hits", "SELECT run_id, rally_number, frame, event_type, call FROM rally_hits QUALIFY row_number() OVER (PARTITION BY run_id, rally_number ORDER BY t DESC, frame DESC, event_id DESC) = 1")
def e06(spark, sf):
    return A.last_hits(rally_hits(spark, sf)).select("run_id", "rally_number", "last.*")


@register(
    "e08_coaching_grouping_sets",
    f"""WITH {CHAIN}, j AS (SELECT h.*, CAST(CASE WHEN rally_hit_sequence % 2 = 1 THEN server ELSE 3 - server END AS INT) AS player,
      CASE WHEN winner IS NULL THEN 'none' WHEN winner = CASE WHEN rally_hit_sequence % 2 = 1 THEN server ELSE 3 - server END THEN 'won' ELSE 'lost' END AS outcome FROM rally_hits h JOIN cw USING (run_id, rally_number))
      SELECT run_id, player, outcome, CAST(grouping(run_id, player, outcome) AS BIGINT) AS level, {SHOTS} FROM j GROUP BY GROUPING SETS ((run_id), (run_id, player), (run_id, player, outcome))""",
)
def e08(spark, sf):
    j = rally_hits(spark, sf).join(chained(spark, sf).select("run_id", "rally_number", "server", "winner"), ["run_id", "rally_number"])
    player = F.when(F.col("rally_hit_sequence") % 2 == 1, F.col("server")).otherwise(3 - F.col("server"))
    j = j.withColumn("player", player).withColumn("outcome", F.when(F.col("winner").isNull(), "none").when(F.col("winner") == F.col("player"), "won").otherwise("lost"))
    return A.coaching(j, 8)


@register(
    "e07_player_outcomes",
    f"""WITH {CHAIN}, j AS (SELECT h.*, CAST(CASE WHEN rally_hit_sequence % 2 = 1 THEN server ELSE 3 - server END AS INT) AS player,
      CASE WHEN winner IS NULL THEN 'none' WHEN winner = CASE WHEN rally_hit_sequence % 2 = 1 THEN server ELSE 3 - server END THEN 'won' ELSE 'lost' END AS outcome FROM rally_hits h JOIN cw USING (run_id, rally_number))
      SELECT run_id, player, outcome, {SHOTS} FROM j WHERE outcome <> 'none' GROUP BY run_id, player, outcome""",
)
def e07(spark, sf):
    return e08(spark, sf).filter("level = 0 AND outcome <> 'none'").drop("level")


@register(
    "e09_pooled_recent_runs",
    f"""WITH r AS (SELECT run_id, max(event_id) AS created FROM hits GROUP BY run_id ORDER BY created DESC, run_id DESC LIMIT 8) SELECT frame % 2 + 1 AS player, {SHOTS} FROM front JOIN r USING (run_id) GROUP BY player""",
)
def e09(spark, sf):
    h = B.hits(spark, sf)
    recent = h.groupBy("run_id").agg(F.max("event_id").alias("created")).orderBy(F.desc("created"), F.desc("run_id")).limit(8).select("run_id")
    pooled = h.filter(C.front_wall(F.col("event_type"))).join(F.broadcast(recent), "run_id")  # eight rows
    return pooled.groupBy((F.col("frame") % 2 + 1).alias("player")).agg(*A.shot_metrics(8))


@register("e10_match_history", "SELECT run_id, row_number() OVER (ORDER BY first_id, run_id) AS match_no, n FROM (SELECT run_id, min(event_id) AS first_id, count(*) AS n FROM hits GROUP BY run_id)")
def e10(spark, sf):
    per = B.hits(spark, sf).groupBy("run_id").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    return per.select("run_id", F.row_number().over(Window.orderBy("first_id", "run_id")).alias("match_no"), "n")


MOVE = """m AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0 THEN t - lag(t) OVER w END AS dt, sqrt(power(x_ft - lag(x_ft) OVER w, 2) + power(y_ft - lag(y_ft) OVER w, 2)) AS step FROM samples WINDOW w AS (PARTITION BY run_id, track ORDER BY t)),
  s AS (SELECT *, least(30.0::DOUBLE, step / dt) AS speed FROM (SELECT * FROM m))"""


@register(
    "e11_movement",
    f"""WITH {MOVE}, q AS (SELECT run_id, track, list(speed ORDER BY speed) FILTER (WHERE speed IS NOT NULL AND dt IS NOT NULL) AS v FROM s GROUP BY ALL)
      SELECT s.run_id, s.track, round(coalesce(sum(CASE WHEN dt IS NOT NULL THEN speed * dt END), 0), 4) AS distance_ft, round(avg(CASE WHEN dt IS NOT NULL THEN speed END), 6) AS avg_speed,
      round(any_value(q.v[CAST(round_even(0.95::DOUBLE * (len(q.v) - 1), 0) AS INT) + 1]), 6) AS p95_speed,
      round(count(*) FILTER (WHERE sqrt(power(x_ft - 10.5, 2) + power(y_ft - 18, 2)) <= 6) * 100.0::DOUBLE / count(*), 1) AS t_pct, round(count(*) FILTER (WHERE y_ft < 16) * 100.0::DOUBLE / count(*), 1) AS front_pct,
      round(sum(CASE WHEN dt <= 0.5 THEN dt ELSE 0 END) / CASE WHEN max(t) > min(t) THEN max(t) - min(t) END, 6) AS coverage FROM s JOIN q USING (run_id, track) GROUP BY s.run_id, s.track""",
)
def e11(spark, sf):
    return A.movement(B.samples(spark, sf), ["run_id", "track"])


@register(
    "e12_heatmap",
    """WITH c AS (SELECT run_id, track, CAST(least(6, greatest(0, floor(x_ft / 21 * 7))) AS INT) AS cx, CAST(least(7, greatest(0, floor(y_ft / 32 * 8))) AS INT) AS cy, count(*) AS n FROM samples GROUP BY ALL)
      SELECT *, round(n / sum(n) OVER (PARTITION BY run_id, track), 6) AS share FROM c""",
)
def e12(spark, sf):
    return A.heatmap(B.samples(spark, sf), ["run_id", "track"])


@register("e13_detection_coverage", "SELECT run_id, round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM track GROUP BY run_id")
def e13(spark, sf):
    return B.track(spark, sf).groupBy("run_id").agg(F.round(F.avg(F.col("detected").cast("double")), 6).alias("coverage"))


@register(
    "e14_robust_threshold",
    """WITH a AS (SELECT run_id, quantile_cont(y, 0.5) AS md, list(y ORDER BY y) AS v FROM track WHERE detected GROUP BY run_id),
      b AS (SELECT t.run_id, quantile_cont(abs(y - md), 0.5) AS mad FROM track t JOIN a ON a.run_id = t.run_id WHERE detected GROUP BY t.run_id), c AS (SELECT *, v[CAST(round_even(0.95::DOUBLE * (len(v) - 1), 0) AS INT) + 1] AS p FROM a JOIN b USING (run_id))
      SELECT run_id, round(md, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN md + 3 * mad WHEN p > md THEN md + (p - md) / 2 END, 6) AS threshold FROM c""",
)
def e14(spark, sf):
    r = A.robust_threshold(B.track(spark, sf).filter("detected"), ["run_id"], "y")
    return r.select("run_id", *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")])


@register(
    "e15_ball_size_ratio",
    """WITH s AS (SELECT run_id, frame, sqrt(width * height) AS size FROM track WHERE detected), c AS (SELECT run_id, quantile_cont(size, 0.5) AS clip FROM s GROUP BY run_id)
      SELECT s.run_id, s.frame, round(quantile_cont(size, 0.5) OVER (PARTITION BY s.run_id ORDER BY s.frame RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / clip, 6) AS ratio FROM s JOIN c ON c.run_id = s.run_id""",
)
def e15(spark, sf):
    s = B.track(spark, sf).filter("detected").select("run_id", "frame", F.sqrt(F.col("width") * F.col("height")).alias("size"))
    clip = s.groupBy("run_id").agg(F.median("size").alias("clip"))
    # A median over a range of frames: neighbours are joined by offset, so the window is a plain aggregate.
    near = s.select("run_id", F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)).alias("frame"), F.col("size").alias("other"))
    local = s.select("run_id", "frame").join(near, ["run_id", "frame"]).groupBy("run_id", "frame").agg(F.median("other").alias("local"))
    return local.join(clip, "run_id").select("run_id", "frame", F.round(F.col("local") / F.col("clip"), 6).alias("ratio"))


@register(
    "e16_identity_confidence",
    """WITH p AS (SELECT *, lag(end_t) OVER (PARTITION BY run_id ORDER BY rally_number) AS pe FROM rallies) SELECT run_id, rally_number, CASE WHEN pe IS NOT NULL THEN
      greatest(0, 1 - (SELECT count(*) FROM hits h WHERE h.run_id = p.run_id AND h.event_type = 'side_wall' AND h.t > pe AND h.t <= start_t))::DOUBLE END AS confidence FROM p""",
)
def e16(spark, sf):
    from .session_queries import per_rally

    moments = B.hits(spark, sf).filter("event_type = 'side_wall'").select("run_id", F.col("t").alias("at"))
    return A.ambiguity_confidence(per_rally(spark, sf), moments)


METRICS = """count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn"""


@register(
    "e18_evaluation_axes",
    """SELECT event_type, call, count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS agree, round(quantile_cont(y, 0.5), 6) AS median_y, round(max(y), 6) AS max_y FROM hits GROUP BY event_type, call""",
)
def e18(spark, sf):
    return B.hits(spark, sf).groupBy("event_type", "call").agg(
        F.count("*").alias("n"), F.count_if(F.col("k") % 3 == 0).alias("agree"), F.round(F.median("y"), 6).alias("median_y"), F.round(F.max("y"), 6).alias("max_y")
    )


@register("e19_manifest_tallies", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'wall') AS wall, count(*) FILTER (WHERE call IS NULL) AS no_call, count(DISTINCT run_id) AS runs, max(event_id) AS latest FROM hits")
def e19(spark, sf):
    return B.hits(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "wall").alias("wall"), F.count_if(F.col("call").isNull()).alias("no_call"), F.countDistinct("run_id").alias("runs"), F.max("event_id").alias("latest")
    )


@register(
    "e20_binary_metrics",
    f"""WITH c AS (SELECT run_id, {METRICS} FROM (SELECT run_id, k % 5 = 0 AS a, y > 0.1 AS p FROM hits) GROUP BY run_id)
      SELECT *, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp::DOUBLE / (5 * tp + 4 * fn + fp) ELSE 0 END, 6) AS f2,
      round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
)
def e20(spark, sf):
    return B.hits(spark, sf).groupBy("run_id").agg(*A.binary_metrics(F.col("k") % 5 == 0, F.col("y") > 0.1))


@register(
    "e22_percentiles",
    """WITH v AS (SELECT run_id, list(y ORDER BY y) AS v FROM hits GROUP BY run_id), m AS (SELECT run_id, quantile_cont(y, 0.5) AS md FROM hits GROUP BY run_id)
      SELECT run_id, round(v[CAST(round_even(0.9::DOUBLE * (len(v) - 1), 0) AS INT) + 1], 6) AS nearest_rank, round(v[CAST(floor(0.9::DOUBLE * (len(v) - 1)) AS INT) + 1], 6) AS floor_rank,
      round(v[CAST(least(floor(0.9::DOUBLE * len(v)), len(v) - 1) AS INT) + 1], 6) AS count_rank, round(md, 6) AS median FROM v JOIN m USING (run_id)""",
)
def e22(spark, sf):
    v = B.hits(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list("y")).alias("v"), F.median("y").alias("m"))
    fs = {"nearest_rank": C.nearest_rank(F.col("v"), 0.9), "floor_rank": C.floor_rank(F.col("v"), 0.9), "count_rank": C.count_rank(F.col("v"), 0.9), "median": F.col("m")}
    return v.select("run_id", *[F.round(c, 6).alias(n) for n, c in fs.items()])


@register("e23_bursts", "SELECT run_id, CAST(1 + sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) AS BIGINT) AS bursts FROM (SELECT run_id, frame - lag(frame) OVER (PARTITION BY run_id ORDER BY frame) AS gap FROM (SELECT DISTINCT run_id, frame FROM front)) GROUP BY run_id")
def e23(spark, sf):
    f = B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).select("run_id", "frame").distinct()
    gap = F.col("frame") - F.lag("frame").over(Window.partitionBy("run_id").orderBy("frame"))
    return f.withColumn("gap", gap).groupBy("run_id").agg((1 + F.count_if(F.col("gap") > 3)).alias("bursts"))


@register("e24_clip_scale", "SELECT run_id, round(least(4.0::DOUBLE, greatest(0.5::DOUBLE, 12 / quantile_cont(width, 0.5))), 6) AS scale FROM track GROUP BY run_id")
def e24(spark, sf):
    return B.track(spark, sf).groupBy("run_id").agg(F.round(F.least(F.lit(4.0), F.greatest(F.lit(0.5), 12 / F.median("width"))), 6).alias("scale"))


@register(
    "e25_best_of_chunk",
    """SELECT run_id, rally_number, round(max(y), 6) AS best, arg_max(frame, struct_pack(a := y, b := -frame)) AS best_seq, len(list(frame)) AS members FROM rally_hits GROUP BY run_id, rally_number""",
)
def e25(spark, sf):
    b = A.best_of_group(rally_hits(spark, sf).select("run_id", "rally_number", "y", "frame"), ["run_id", "rally_number"], "y", "frame")
    return b.select("run_id", "rally_number", F.round("best", 6).alias("best"), "best_seq", F.size("members").cast("long").alias("members"))


@register("e26_balanced_weights", "SELECT event_type, round(n_all::DOUBLE / (k * n), 6) AS weight, n FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS n_all, count(*) OVER () AS k FROM hits GROUP BY event_type)")
def e26(spark, sf):
    w = A.balanced_weights(B.hits(spark, sf).select("event_type"), "event_type")
    return w.groupBy("event_type").agg(F.round(F.max("weight"), 6).alias("weight"), F.count("*").alias("n"))


@register(
    "e30_minmax_selection",
    """SELECT run_id, CAST(arg_min(o, struct_pack(a := worst, b := ord)) AS INT) AS offset_, round(min(worst), 6) AS worst FROM (
      SELECT run_id, o, ord, max(abs(y - (0.05 + o * 0.01))) AS worst FROM hits, (VALUES (0, 0), (-1, 1), (1, 2)) v(o, ord) GROUP BY run_id, o, ord) GROUP BY run_id""",
)
def e30(spark, sf):
    offsets = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("ord")) for i, o in enumerate((0, -1, 1))]))
    worst = B.hits(spark, sf).select("run_id", "y", offsets.alias("v")).groupBy("run_id", "v").agg(F.max(F.abs(F.col("y") - (0.05 + F.col("v.o") * 0.01))).alias("worst"))
    best = worst.groupBy("run_id").agg(F.min(F.struct("worst", F.col("v.ord").alias("ord"), F.col("v.o").alias("o"))).alias("b"))
    return best.select("run_id", F.col("b.o").alias("offset_"), F.round("b.worst", 6).alias("worst"))
