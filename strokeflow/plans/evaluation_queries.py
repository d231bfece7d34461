"""Queries over choosing, splitting, weighing and measuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import camera as V
from ..operators import evaluation as E
from . import bindings as B
from .judging_queries import PLACED, placed, y_at


def clips(spark, sf):
    return B.track(spark, sf).select(F.concat(F.lit("clip"), "run_id").alias("clip"), "frame", (F.col("width") * 100).alias("width"))


@register("c17_eligible_clips", "SELECT 'clip' || run_id AS clip, frame FROM track WHERE run_id NOT IN (1, 3) AND width * 100 >= 450")
def c17(spark, sf):
    c = clips(spark, sf)
    return E.eligible(c, c, ["clip1", "clip3"], 450.0).select("clip", "frame")


@register("c18_contact_volume", "SELECT run_id, track, t, x_ft - 4 BETWEEN -2 AND 23 AND y_ft + 3 BETWEEN -2 AND 34 AND (t * 4) % 37 / 2 - 0.9::DOUBLE BETWEEN -2 AND 17 AS plausible FROM samples")
def c18(spark, sf):
    z = F.pmod(F.col("t") * 4, F.lit(37)) / 2 - 0.9
    return B.samples(spark, sf).select("run_id", "track", "t", V.in_court(F.col("x_ft") - 4, F.col("y_ft") + 3, z).alias("plausible"))


@register(
    "c19_wall_region",
    f"""WITH {PLACED} SELECT run_id, frame, x BETWEEN least(tx0, tx1, bx0, bx1) - 15 AND greatest(tx0, tx1, bx0, bx1) + 15 AND y <= by0 + least(1, greatest(0, (x - bx0) / (bx1 - bx0))) * (by1 - by0) + 20 AS inside FROM p""",
)
def c19(spark, sf):
    return placed(spark, sf).select("run_id", "frame", E.wall_region(F.col("cal"), F.col("x"), F.col("y"), 15.0, 20.0).alias("inside"))


def sluggish(spark, sf):
    from ..functions.columns import slug

    pages = B.read(spark, sf, "pages")
    videos = pages.filter("page_id % 3 > 0").select(slug(F.col("url")).alias("slug"), F.col("page_id").alias("video"))
    return E.by_slug(pages.select(slug(F.col("url")).alias("slug"), "page_id"), videos)


@register("d18_slug_join", "SELECT a.page_id, b.page_id AS video FROM pages a JOIN pages b ON a.url = b.url WHERE b.page_id % 3 > 0")
def d18(spark, sf):
    return sluggish(spark, sf)[0].select("page_id", "video")


@register("d18_missing_videos", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 > 0)")
def d18_missing(spark, sf):
    return sluggish(spark, sf)[1].select("page_id")


@register("d19_geometry_by_source", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'own' || c_nationkey ELSE 'default' END AS geometry FROM customer")
def d19(spark, sf):
    own = B.read(spark, sf, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("source"), F.concat(F.lit("own"), "n_nationkey").alias("geometry"))
    return E.with_default(B.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("source")), own, F.lit("default")).select("c_custkey", "geometry")


@register(
    "d23_landmark_matches",
    """WITH RECURSIVE q AS (SELECT run_id * 1000 + frame // 40 AS run_id, row_number() OVER (PARTITION BY run_id, frame // 40 ORDER BY frame) AS i, x / 500 AS x, y / 500 AS y, frame % 2 AS side FROM track WHERE detected),
      a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i) AS n FROM q WHERE side = 0), b AS (SELECT run_id, list(struct_pack(i := i, x := x, y := y) ORDER BY i) AS bs FROM q WHERE side = 1 GROUP BY run_id),
      s AS (SELECT run_id, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS i, NULL::BIGINT AS j FROM b
        UNION ALL SELECT run_id, n, CASE WHEN m.d < 0.3 THEN list_append(used, m.i) ELSE used END, i, CASE WHEN m.d < 0.3 THEN m.i END FROM (
          SELECT s.run_id, a.n, s.used, a.i, list_sort(list_transform(list_filter(b.bs, lambda p: NOT list_contains(s.used, p.i)), lambda p: struct_pack(d := sqrt(power(p.x - a.x, 2) + power(p.y - a.y, 2)), i := p.i)))[1] AS m
          FROM s JOIN a ON a.run_id = s.run_id AND a.n = s.n + 1 JOIN b ON b.run_id = s.run_id))
      SELECT run_id, i, j FROM s WHERE j IS NOT NULL""",
)
def d23(spark, sf):
    from pyspark.sql import Window

    part = F.floor(F.col("frame") / 40)
    i = F.row_number().over(Window.partitionBy("run_id", part).orderBy("frame")).cast("long")
    q = B.track(spark, sf).filter("detected").select((F.col("run_id") * 1000 + part).alias("run_id"), i.alias("i"), (F.col("x") / 500).alias("x"), (F.col("y") / 500).alias("y"), (F.col("frame") % 2).alias("side"))
    return E.match_landmarks(q.filter("side = 0").drop("side"), q.filter("side = 1").drop("side"), 0.3).select("run_id", "i", "j")


@register(
    "e26_reweighted_examples",
    """WITH l AS (SELECT event_id, CASE WHEN event_type = 'wall' THEN 1 ELSE 0 END AS label, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS predicted FROM hits), n AS (SELECT label, count(*) AS n FROM l GROUP BY label)
      SELECT event_id, round((SELECT count(*) FROM l) / (2.0::DOUBLE * n.n) * CASE WHEN l.label = 0 AND predicted = 1 THEN 3 WHEN l.label = 1 AND predicted = 0 THEN 2 ELSE 1 END, 8) AS weight FROM l JOIN n ON n.label = l.label""",
)
def e26_hard(spark, sf):
    rows = B.hits(spark, sf).select("event_id", (F.coalesce(F.col("event_type") == "wall", F.lit(False))).cast("int").alias("label"), (F.col("k") >= 50).cast("int").alias("predicted"))
    return E.reweighted(rows, 3.0, 2.0).select("event_id", F.round("weight", 8).alias("weight"))


@register(
    "e27_projected_cost",
    "SELECT p_partkey, floor(floor(p_retailprice * 30) / 4) AS frames, round(floor(floor(p_retailprice * 30) / 4) * 18 * p_size / 1000 * 6 / 3600 * 30 * 1.29::DOUBLE, 6) AS usd_month FROM part",
)
def e27(spark, sf):
    p = B.read(spark, sf, "part").select("p_partkey", F.lit(18).alias("tiles_per_frame"), F.lit(30).alias("fps"), F.col("p_retailprice").alias("duration"), "p_size")
    return E.projected_cost(p, F.col("p_size"), 4, 6, 1.29).select("p_partkey", F.col("frames").cast("double").alias("frames"), F.round("usd_month", 6).alias("usd_month"))


@register("e27_benchmark_medians", "SELECT p_brand, median(p_retailprice) AS median, min(p_retailprice) AS best FROM part GROUP BY p_brand")
def e27_medians(spark, sf):
    return B.read(spark, sf, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("median"), F.min("p_retailprice").alias("best"))


@register("e29_pair_agreement", "SELECT run_id, count(*) AS n, round(median(e), 6) AS median_error, round(max(e), 6) AS max_error FROM (SELECT run_id, sqrt(power(x_ft - 10.5, 2) + power(y_ft - 16, 2)) AS e FROM samples WHERE NOT coasted) GROUP BY run_id")
def e29(spark, sf):
    s = B.samples(spark, sf).select("run_id", F.when(F.col("coasted"), float("nan")).otherwise(F.hypot(F.col("x_ft") - 10.5, F.col("y_ft") - 16)).alias("error"))
    return E.agreement(s, ["run_id"]).withColumns({c: F.round(c, 6) for c in ("median_error", "max_error")})


@register(
    "e31_players",
    """WITH s AS (SELECT run_id, max(x_ft) FILTER (WHERE track = 'A' AND run_id % 4 > 0) AS a, max(x_ft) FILTER (WHERE track = 'B') AS b FROM samples GROUP BY run_id)
      SELECT run_id, CASE WHEN run_id % 5 > 0 THEN 'players-v2' END AS schema, CASE WHEN run_id % 5 > 0 THEN round(coalesce(a, 0), 6) END AS distance_a, CASE WHEN run_id % 5 > 0 THEN round(coalesce(b, 0), 6) END AS distance_b FROM s""",
)
def e31(spark, sf):
    stats = B.samples(spark, sf).filter("track = 'B' OR run_id % 4 > 0").groupBy("run_id", "track").agg(F.max("x_ft").alias("distance_ft"), F.lit(1.0).alias("coverage"))
    got = E.players(stats, F.col("run_id") % 5 > 0, F.lit(0), "boxes")
    return got.select("run_id", "players.schema", F.round("players.player_a.distance_ft", 6).alias("distance_a"), F.round("players.player_b.distance_ft", 6).alias("distance_b"))


@register(
    "f20_prominent_peaks",
    """WITH q AS (SELECT run_id, frame, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id) AS n, lag(y) OVER w AS a, lead(y) OVER w AS b FROM hits WINDOW w AS (PARTITION BY run_id ORDER BY frame)),
      f AS (SELECT q.run_id, q.i, median(z.y) AS m FROM q, (SELECT unnest(range(-3, 4)) AS d) e, q z WHERE z.run_id = q.run_id AND z.i = least(q.n, greatest(1, q.i + e.d)) GROUP BY q.run_id, q.i)
      SELECT q.run_id, frame, round(y - m, 8) AS prominence FROM q JOIN f ON f.run_id = q.run_id AND f.i = q.i WHERE y - m >= 0.05 AND y >= a AND y >= b""",
)
def f20(spark, sf):
    got = E.prominent_peaks(B.hits(spark, sf).select("run_id", "frame", "y"), "y", 7, 0.05)
    return got.select("run_id", "frame", F.round("prominence", 8).alias("prominence"))


@register("h04_run_list", "SELECT run_id, row_number() OVER (ORDER BY created DESC, run_id DESC) AS place FROM (SELECT run_id, max(event_id) AS created FROM hits GROUP BY run_id)")
def h04(spark, sf):
    """Newest first, with the place in the list: one row per run is what the one window sees."""
    from pyspark.sql import Window

    per = B.hits(spark, sf).groupBy("run_id").agg(F.max("event_id").alias("created"))
    return per.select("run_id", F.row_number().over(Window.orderBy(F.desc("created"), F.desc("run_id"))).cast("long").alias("place"))


RESULTS = "m AS (SELECT p_partkey AS setting, p_brand AS brand, (p_partkey % 10) / 10.0::DOUBLE AS precision, (p_size % 5) / 5.0::DOUBLE AS recall, (p_partkey % 3) / 3.0::DOUBLE AS accuracy FROM part)"


@register(
    "h06_best_setting",
    f"""WITH {RESULTS}, f AS (SELECT *, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS fb, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
      SELECT brand, setting, round(fb, 8) AS f_beta FROM f QUALIFY row_number() OVER (PARTITION BY brand ORDER BY precision >= 0.3 DESC, round(fb, 12) DESC, recall DESC, precision DESC, round(f1, 12) DESC, accuracy DESC, setting) = 1""",
)
def h06(spark, sf):
    k = F.col("p_partkey")
    rows = B.read(spark, sf, "part").select(k.alias("setting"), F.col("p_brand").alias("brand"), (k % 10 / 10).alias("precision"), (F.col("p_size") % 5 / 5).alias("recall"), (k % 3 / 3).alias("accuracy"))
    return E.best_setting(rows, ["brand"], ["setting"]).select("brand", "setting", F.round("f_beta", 8).alias("f_beta"))


@register("h07_worst_residuals", "SELECT run_id, frame, rank FROM (SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY abs(k - 50) DESC, frame) AS rank FROM hits) WHERE rank <= 5")
def h07(spark, sf):
    rows = B.hits(spark, sf).select("run_id", "frame", F.abs(F.col("k") - 50).alias("residual"))
    return E.worst_first(rows, ["run_id"], "frame").filter("rank <= 5").select("run_id", "frame", F.col("rank").cast("long").alias("rank"))


@register("i09_split_by_clip", "SELECT 'clip' || run_id AS clip, CASE WHEN run_id IN (1, 2) THEN 'val' WHEN run_id = 5 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM track GROUP BY ALL")
def i09_clips(spark, sf):
    return E.split_by_clip(clips(spark, sf), ["clip1", "clip2"], ["clip5"]).groupBy("clip", "split").agg(F.count("*").alias("n"))


@register(
    "i09_oversampled",
    """WITH l AS (SELECT event_id, CASE WHEN event_type = 'wall' THEN 1 ELSE 0 END AS label FROM hits), n AS (SELECT label, count(*) AS n FROM l GROUP BY label),
      r AS (SELECT l.event_id, n.n, (SELECT max(n) FROM n) AS most, row_number() OVER (PARTITION BY l.label ORDER BY md5('sample' || l.event_id), l.event_id) AS r FROM l JOIN n ON n.label = l.label)
      SELECT event_id, unnest(range(1, most // n + CASE WHEN r <= most % n THEN 1 ELSE 0 END + 1)) AS copy FROM r""",
)
def i09_oversampled(spark, sf):
    rows = B.hits(spark, sf).select("event_id", F.coalesce(F.col("event_type") == "wall", F.lit(False)).cast("int").alias("label"))
    return E.oversampled(rows, "event_id").select("event_id", F.col("copy").cast("long").alias("copy"))


@register(
    "j15_geometry_features",
    f"""WITH {PLACED}, g AS (SELECT *, y - {y_at('t', 'x')} AS a, {y_at('b', 'x')} - y AS b FROM p) SELECT run_id, frame, CASE WHEN x BETWEEN 30 AND 980 THEN 1.0::DOUBLE ELSE 0 END AS inside_tin, round((x - 30) / 950, 9) AS wall_x,
      round(a / (a + b), 9) AS wall_y, round(least(abs(a), abs(b)), 9) AS nearest_line, round(least(a, b), 9) AS margin FROM g""",
)
def j15(spark, sf):
    got = E.geometry_features(placed(spark, sf), F.lit(30.0), F.lit(980.0))
    return got.select("run_id", "frame", "inside_tin", *[F.round(c, 9).alias(c) for c in ("wall_x", "wall_y", "nearest_line", "margin")])


@register(
    "j24_report_check",
    "SELECT s_suppkey, s_suppkey % 2 > 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AS valid FROM supplier",
)
def j24(spark, sf):
    k = F.col("s_suppkey")
    text = lambda bad: F.when(bad, " ").otherwise("x")
    player = lambda obs, drill: F.struct(F.array(F.lit("o"), text(obs)).alias("observations"), F.lit("d").alias("drill_name"), F.lit("i").alias("drill_instructions"), text(drill).alias("drill_goal"))
    body = F.to_json(F.struct(F.when(k % 2 > 0, "s").alias("summary"), F.struct(player(k % 3 == 0, F.lit(False)).alias("1"), player(F.lit(False), k % 5 == 0).alias("2")).alias("players")))
    return B.read(spark, sf, "supplier").select("s_suppkey", E.valid_report(F.when(k % 7 == 0, "{").otherwise(body)).alias("valid"))


@register("j28_settings", "SELECT event_id, CASE WHEN k % 3 = 0 THEN k / 4.0::DOUBLE ELSE 0.2::DOUBLE END AS value FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def j28(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    given = F.when(k % 3 == 0, F.concat(F.lit(" "), (k / 4.0).cast("string"))).when(k % 3 == 1, "").otherwise("4x")
    return B.read(spark, sf, "events").select("event_id", E.setting(given, F.lit(0.2)).alias("value"))


@register(
    "j29_frame_ranges",
    """WITH r AS (SELECT event_id, CASE WHEN k % 4 = 0 THEN k ELSE CAST(floor(CASE WHEN k % 4 = 1 THEN k / 10.0::DOUBLE ELSE 0 END * 30) AS BIGINT) END AS a, least(CASE WHEN k % 5 = 0 THEN k - 7 ELSE 79 END, 79) AS b FROM hits)
      SELECT event_id, a AS "first", b AS "last", CASE WHEN a >= 80 THEN 'starts after the end' WHEN b < a THEN 'ends before the start' END AS error FROM r""",
)
def j29(spark, sf):
    k = F.col("k").cast("long")
    rows = B.hits(spark, sf).select("event_id", F.when(k % 4 == 0, k).alias("start_frame"), F.when(k % 4 == 1, k / 10.0).alias("start_seconds"), F.when(k % 5 == 0, k - 7).alias("end_frame"), F.lit(30.0).alias("fps"), F.lit(80).cast("long").alias("frame_count"))
    return E.frame_range(rows).select("event_id", "first", "last", "error")


@register("j29_grids", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size + 0.5::DOUBLE END AS total FROM part")
def j29_grids(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, " , ").when(k % 7 == 0, "1,x").otherwise(F.concat(F.lit(" 0.5, ,"), F.col("p_size").cast("string")))
    return B.read(spark, sf, "part").select("p_partkey", F.aggregate(E.parsed_grid(text), F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("j30_safe_names", "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace('../' || url, '[/\\\\]+', ' ', 'g'), '\\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g'), '') AS name FROM pages")
def j30(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", E.safe_name(F.concat(F.lit("../"), "url")).alias("name"))
