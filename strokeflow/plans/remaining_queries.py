"""Queries over line formats, steps, slopes, ranks, cases and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import fits, sessions, sets, trajectory
from ..sources import documents as S
from ..sources import files
from . import bindings as B


@register("a09_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 10 > 1")
def a09(spark, sf):
    """Lines with comments, blanks and malformed ones among them."""
    n = F.col("event_id") % 10
    row = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))
    lines = B.read(spark, sf, "events").select(F.when(n == 0, F.concat(F.lit("  // "), row)).when(n == 1, "  ").otherwise(row).alias("value"))
    return files.json_lines(lines, "event_id bigint, k int")


@register("b01_track_lines", "SELECT run_id, frame, printf('%.6f', floor(t * 8) / 8) AS t, CAST(detected AS VARCHAR) AS detected, CASE WHEN detected THEN printf('%.3f', floor(x * 4) / 4) ELSE '' END AS x, CASE WHEN detected THEN printf('%.3f', y) ELSE '' END AS y FROM track")
def b01(spark, sf):
    """Places in quarters of a pixel and eighths of a second, which have three decimals at most."""
    t = B.track(spark, sf)
    return files.track_lines(t.withColumns({"x": F.floor(F.col("x") * 4) / 4, "t": F.floor(F.col("t") * 8) / 8}))


@register("b05_track_samples", "SELECT run_id, track, count(*) AS n, max(t) AS last_t, count(*) FILTER (WHERE coasted) AS coasted FROM samples GROUP BY run_id, track")
def b05(spark, sf):
    """A document of samples per run and track, written and read back."""
    s = B.samples(spark, sf)
    body = s.groupBy("run_id", "track").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("t", "x_ft", "y_ft", "coasted"))).alias("samples"))).alias("body"))
    got = body.select("run_id", "track", F.from_json("body", "samples array<struct<t:double,coasted:boolean>>")["samples"].alias("s"))
    return got.select("run_id", "track", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: x["t"])).alias("last_t"), F.size(F.filter("s", lambda x: x["coasted"])).cast("long").alias("coasted"))


@register("b10_player_names", "SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM supplier WHERE s_suppkey % 6 <> 3")
def b10(spark, sf):
    k = F.col("s_suppkey").alias("run_id")
    s = B.read(spark, sf, "supplier").select(k)
    new = s.filter("run_id % 3 = 0").select("run_id", F.when(F.col("run_id") % 6 == 0, "new").alias("payload"))
    return files.upsert(s.select("run_id", F.lit("old").alias("payload")), new, ["run_id"])


@register("b11_deleted_runs", "SELECT run_id, count(*) AS n FROM hits WHERE NOT (run_id % 4 = 0 AND run_id % 8 <> 0) GROUP BY run_id")
def b11(spark, sf):
    """Runs that are to go stay while they are running."""
    h = B.hits(spark, sf)
    wanted = h.select("run_id").distinct().filter("run_id % 4 = 0").withColumn("status", F.when(F.col("run_id") % 8 == 0, "running").otherwise("done"))
    return S.without_runs(h, wanted).groupBy("run_id").agg(F.count("*").alias("n"))


@register(
    "b18_silver_labels",
    """WITH c AS (SELECT run_id, t, 1 + sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame) AS c FROM (SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY frame) AS gap FROM front)),
      r AS (SELECT run_id, c, min(t) AS s, max(t) AS e, count(*) AS n FROM c GROUP BY run_id, c HAVING count(*) >= 2) SELECT run_id, count(*) AS rallies, round(min(s), 6) AS first_start, round(max(e), 6) AS last_end, false AS verified FROM r GROUP BY run_id""",
)
def b18(spark, sf):
    """Rally labels from clusters of hits, as JSON lines read back."""
    from .session_queries import front

    c = sessions.segment(front(spark, sf), 5.0, inclusive=False).groupBy("run_id", "rally_number").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("n")).filter("n >= 2")
    lines = c.groupBy("run_id").agg(F.to_json(F.struct("run_id", F.lit(False).alias("verified"), F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("rallies"))).alias("value"))
    got = files.json_lines(lines.select("value"), "run_id bigint, verified boolean, rallies array<struct<start_s:double,end_s:double>>")
    return got.select("run_id", F.size("rallies").cast("long").alias("rallies"), F.round(F.get("rallies", F.lit(0))["start_s"], 6).alias("first_start"), F.round(F.array_max(F.transform("rallies", lambda r: r["end_s"])), 6).alias("last_end"), "verified")


@register(
    "c12_without_stationary",
    """WITH s AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS st FROM (SELECT run_id, frame, x / 90 AS x, y / 90 AS y FROM track WHERE detected) WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
      n AS (SELECT run_id, frame, x, count(*) OVER w AS near, sqrt(power(max(x) OVER w - min(x) OVER w, 2) + power(max(y) OVER w - min(y) OVER w, 2)) AS span, sum(st) OVER w - first_value(st) OVER w AS path FROM s
        WINDOW w AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING))
      SELECT run_id, frame, CASE WHEN near >= 4 AND span < 12 AND path < 18 THEN NULL ELSE round(x, 6) END AS x FROM n""",
)
def c12(spark, sf):
    t = B.track(spark, sf).filter("detected").select("run_id", "frame", (F.col("x") / 90).alias("x"), (F.col("y") / 90).alias("y"))
    return trajectory.neighbourhood(t, 8).select("run_id", "frame", F.when(~F.col("stationary"), F.round("x", 6)).alias("x"))


@register("d17_export_neighbours", "SELECT a.run_id, a.frame, p.frame AS before, n.frame AS after FROM (SELECT run_id, frame FROM track WHERE detected) a LEFT JOIN (SELECT run_id, frame FROM track WHERE detected) p ON p.run_id = a.run_id AND p.frame = a.frame - 1 LEFT JOIN (SELECT run_id, frame FROM track WHERE detected) n ON n.run_id = a.run_id AND n.frame = a.frame + 1")
def d17(spark, sf):
    """The images of the frames right before and after, where the export has them."""
    w = Window.partitionBy("run_id").orderBy("frame")
    t = B.track(spark, sf).filter("detected").select("run_id", "frame", F.lag("frame").over(w).alias("p"), F.lead("frame").over(w).alias("n"))
    return t.select("run_id", "frame", F.when(F.col("p") == F.col("frame") - 1, F.col("p")).alias("before"), F.when(F.col("n") == F.col("frame") + 1, F.col("n")).alias("after"))


@register(
    "f03_steps",
    """SELECT run_id, track, t, round(dt, 6) AS dt, round(least(30, sqrt(power(x_ft - px, 2) + power(y_ft - py, 2)) / dt), 6) AS speed FROM (SELECT *, t - lag(t) OVER w AS dt, lag(x_ft) OVER w AS px, lag(y_ft) OVER w AS py FROM samples WINDOW w AS (PARTITION BY run_id, track ORDER BY t)) WHERE dt > 0""",
)
def f03(spark, sf):
    got = trajectory.steps(B.samples(spark, sf), ["run_id", "track"], C.SPEED_MAX_FTPS)
    return got.select("run_id", "track", "t", F.round("dt", 6).alias("dt"), F.round("speed", 6).alias("speed"))


@register(
    "f12_velocity_around",
    """WITH s AS (SELECT run_id, frame, regr_slope(x, frame::DOUBLE) OVER b AS xb, regr_slope(y, frame::DOUBLE) OVER b AS yb, regr_slope(x, frame::DOUBLE) OVER a AS xa, regr_slope(y, frame::DOUBLE) OVER a AS ya, count(*) OVER b AS nb, count(*) OVER a AS na FROM track WHERE detected
        WINDOW b AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), a AS (PARTITION BY run_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING)),
      v AS (SELECT *, sqrt(xb * xb + yb * yb) AS sb, sqrt(xa * xa + ya * ya) AS sa FROM s WHERE nb >= 2 AND na >= 2)
      SELECT run_id, frame, round(sb, 8) AS speed_before, round(sa, 8) AS speed_after, round(sa / nullif(sb, 0), 8) AS ratio, round(degrees(acos(greatest(-1, least(1, (xb * xa + yb * ya) / nullif(sb * sa, 0))))), 3) AS turn FROM v""",
)
def f12(spark, sf):
    got = trajectory.velocity_around(B.track(spark, sf).filter("detected"), 5)
    return got.select("run_id", "frame", *[F.round(c, 8).alias(c) for c in ("speed_before", "speed_after", "ratio")], F.round("turn", 3).alias("turn"))


@register(
    "g18_audio_peaks",
    """WITH RECURSIVE r AS (SELECT run_id, CAST(round(t * 1000) AS BIGINT) AS ms, row_number() OVER (PARTITION BY run_id ORDER BY speed_before DESC, event_id) AS i FROM hits),
      s AS (SELECT run_id, i, [ms] AS kept FROM r WHERE i = 1 UNION ALL SELECT r.run_id, r.i, CASE WHEN len(list_filter(s.kept, lambda k: abs(k - r.ms) < 9000)) > 0 OR len(s.kept) >= 32 THEN s.kept ELSE list_append(s.kept, r.ms) END FROM s JOIN r ON r.run_id = s.run_id AND r.i = s.i + 1),
      z AS (SELECT run_id, kept FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i DESC) = 1) SELECT run_id, unnest(kept) AS ms FROM z""",
)
def g18(spark, sf):
    """Peaks by time: a distance in milliseconds and a most of 32."""
    h = B.hits(spark, sf).select("run_id", F.round(F.col("t") * 1000).cast("long").alias("frame"), F.col("speed_before").alias("score"), F.col("event_id").alias("seq"))
    return sessions.suppress_peaks(h, 9000, 32).select("run_id", F.col("frame").alias("ms"))


@register(
    "g22_rescue_windows",
    """WITH b AS (SELECT run_id, min(frame) AS low, max(frame) AS high FROM hits GROUP BY run_id), x AS (SELECT run_id, greatest(frame - 4, low) AS s, least(frame + 4, high) AS e FROM hits JOIN b USING (run_id) WHERE call IS NULL)
      SELECT run_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM (SELECT *, sum(CASE WHEN s - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e) AS i FROM (
      SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)) GROUP BY run_id, i""",
)
def g22(spark, sf):
    return sessions.refine_windows(B.bounded(B.hits(spark, sf)).filter("call IS NULL"), 4, F.col("first_frame"), F.col("last_frame"))


@register("g28_fingerprint_clusters")
def g28(spark, sf):
    e = B.read(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return fits.cluster_fingerprints(e.select(F.col("label").cast("long").alias("run_id"), F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x / norm).alias("v")), 0.2)


@register("h01_top_zones", "SELECT run_id, zone, n FROM (SELECT run_id, k // 12 AS zone, count(*) AS n FROM hits GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, zone) <= 3")
def h01(spark, sf):
    per = B.hits(spark, sf).groupBy("run_id", F.floor(F.col("k") / 12).cast("int").alias("zone")).agg(F.count("*").alias("n"))
    return sets.top_n(per, ["run_id"], [F.desc("n"), F.col("zone")], 3).select("run_id", "zone", "n")


@register("h09_case_order", "SELECT event_id, row_number() OVER (PARTITION BY kind ORDER BY run, frame, event_id) AS place FROM (SELECT event_id, coalesce(event_type, '') AS kind, CASE WHEN k % 4 = 0 THEN '' ELSE CAST(run_id AS VARCHAR) END AS run, frame FROM hits)")
def h09(spark, sf):
    h = B.hits(spark, sf).withColumn("run", F.when(F.col("k") % 4 > 0, F.col("run_id").cast("string")))
    w = Window.partitionBy(F.coalesce("event_type", F.lit(""))).orderBy(F.coalesce("run", F.lit("")), "frame", "event_id")
    return h.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@register(
    "i07_collected_cases",
    """SELECT 'correction' AS kind, 'corr:' || run_id || ':' || frame AS case_id FROM hits WHERE k % 3 = 0 AND k % 7 > 0 UNION ALL SELECT 'ground_truth_event', 'gt:' || run_id || ':' || frame FROM hits WHERE k % 3 = 1 AND event_type IN ('wall', 'side_wall', 'floor', 'racket') AND run_id % 4 > 0
      UNION ALL SELECT 'label_csv_event', 'lbl:f' || run_id || '.csv:' || frame FROM hits WHERE k % 3 = 2""",
)
def i07(spark, sf):
    """Corrections of a known kind, truth of runs that were detected, and label files."""
    h = B.hits(spark, sf)
    corrections = h.filter("k % 3 = 0").select("run_id", "frame", F.when(F.col("k") % 7 > 0, "none").otherwise("v1").alias("type"))
    truth = h.filter("k % 3 = 1").select("run_id", "frame", F.upper("event_type").alias("type"))
    detected = h.select("run_id").distinct().filter("run_id % 4 > 0")
    labels = h.filter("k % 3 = 2").select(F.concat(F.lit("f"), "run_id", F.lit(".csv")).alias("name"), "frame")
    return S.collected_cases(corrections, truth, detected, labels)


@register("i11_slug_divergence", "SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS clip FROM pages WHERE regexp_matches(url, '[^A-Za-z0-9._-]')")
def i11(spark, sf):
    p = B.read(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("clip"), "url")
    return p.filter(C.slug(F.col("url")) != F.col("url")).select("clip").distinct()


@register("k05_homography_fits", "SELECT s_suppkey AS run_id, s_suppkey % 3 > 0 AS solved, s_suppkey % 3 > 0 AS exact, CASE WHEN s_suppkey % 3 > 0 THEN 2.0::DOUBLE + s_suppkey % 5 END AS scale FROM supplier")
def k05(spark, sf):
    """Five landmarks per run under a known map; every third run has three of them."""
    s = B.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"))
    at = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (21, 0), (21, 32), (0, 32), (10, 15))])
    p = s.select("run_id", F.inline(F.when(F.col("run_id") % 3 == 0, F.slice(at, 1, 3)).otherwise(at)))
    w = 1 + 0.01 * F.col("y")
    p = p.withColumns({"u": ((2.0 + F.col("run_id") % 5) * F.col("x") + 7) / w, "v": (3 * F.col("y") + 11) / w})
    got = fits.fit_homographies(p)
    return got.select("run_id", F.col("h").isNotNull().alias("solved"), F.coalesce(F.col("worst") < 1e-6, F.lit(False)).alias("exact"), F.round(F.get("h", F.lit(0)), 6).alias("scale"))
