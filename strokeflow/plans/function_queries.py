"""Queries over column functions and predicates (C, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from . import bindings as B


@register("c06_finite_points", "SELECT run_id, count(*) AS n FROM track WHERE detected AND x IS NOT NULL AND isfinite(x) GROUP BY run_id")
def c06(spark, sf):
    return B.track(spark, sf).filter(F.col("detected") & ~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("run_id").agg(F.count("*").alias("n"))


@register("c07_hit_predicates", "SELECT run_id, frame, event_type IS NULL OR event_type IN ('wall', 'unknown') AS front_wall, frame = 1 AS serve, call IN ('IN', 'OUT') AS assignable FROM hits")
def c07(spark, sf):
    kind = F.col("event_type")
    return B.hits(spark, sf).select("run_id", "frame", C.front_wall(kind).alias("front_wall"), (F.col("frame") == 1).alias("serve"), F.col("call").isin("IN", "OUT").alias("assignable"))


@register("c08_range_gate", "SELECT run_id, frame FROM track WHERE detected AND x BETWEEN least(900, 200) - 10 AND greatest(900, 200) + 10")
def c08(spark, sf):
    return B.track(spark, sf).filter(F.col("detected") & C.inside_quad_x(F.lit(900), F.lit(200), F.col("x"), 10)).select("run_id", "frame")


@register(
    "c13_capability_reasons",
    """SELECT l_orderkey, l_linenumber, reasons = '' AS enabled, reasons FROM (SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity < 10 THEN 'too narrow' END, CASE WHEN l_discount < 0.02 THEN 'not sharp' END, CASE WHEN l_tax > 0.06 THEN 'no solved court' END], lambda z: z IS NOT NULL), '; ') AS reasons FROM lineitem)""",
)
def c13(spark, sf):
    parts = F.array_compact(F.array(F.when(F.col("l_quantity") < 10, "too narrow"), F.when(F.col("l_discount") < 0.02, "not sharp"), F.when(F.col("l_tax") > 0.06, "no solved court")))
    return B.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.size(parts) == 0).alias("enabled"), F.concat_ws("; ", parts).alias("reasons"))


@register("j06_target_zone", f"SELECT run_id, frame, CAST((CASE WHEN x < 0.21 THEN 0 WHEN x <= 0.79 THEN 1 ELSE 2 END) * 3 + (CASE WHEN y < 0.324 THEN 0 WHEN y < {C.SERVICE_Y}::DOUBLE THEN 1 ELSE 2 END) + 1 AS INT) AS zone FROM hits")
def j06(spark, sf):
    return B.hits(spark, sf).select("run_id", "frame", C.target_zone(F.col("x"), F.col("y")).alias("zone"))


@register("j08_heights_and_speeds", f"SELECT run_id, frame, round({C.OUT_FT}::DOUBLE - y * {C.OUT_FT - C.TIN_FT}::DOUBLE, 6) AS height_ft, round(speed_before * 0.6818181818::DOUBLE, 6) AS mph FROM hits")
def j08(spark, sf):
    return B.hits(spark, sf).select("run_id", "frame", F.round(C.wall_height_ft(F.col("y")), 6).alias("height_ft"), F.round(C.mph(F.col("speed_before")), 6).alias("mph"))


@register(
    "j12_weighted_vote",
    """WITH v AS (SELECT run_id, frame, CASE WHEN k % 4 > 0 THEN greatest(-1, least(1, (k - 50) / 40.0::DOUBLE)) END AS a, CASE WHEN k % 3 > 0 THEN greatest(-1, least(1, (y - 0.1) / 0.35::DOUBLE)) END AS b FROM hits),
      s AS (SELECT *, (coalesce(a, 0) * 0.4::DOUBLE + coalesce(b, 0) * 0.35::DOUBLE) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.35::DOUBLE END, 0) AS z FROM v)
      SELECT run_id, frame, round(z, 6) AS score, CASE WHEN z >= 0.15 THEN 'wall' WHEN z <= -0.15 THEN 'racket' ELSE 'unknown' END AS kind FROM s""",
)
def j12(spark, sf):
    audio = F.when(F.col("k") % 4 > 0, C.clip_unit((F.col("k") - 50) / 40.0))
    size = F.when(F.col("k") % 3 > 0, C.clip_unit((F.col("y") - 0.1) / 0.35))
    score, kind = C.vote([(audio, 0.4), (size, 0.35)])
    return B.hits(spark, sf).select("run_id", "frame", F.round(score, 6).alias("score"), kind.alias("kind"))


@register("j13_scaled_frames", "SELECT DISTINCT CAST(l_quantity AS INT) AS fps, greatest(1, CAST(round_even(10 * l_quantity / 60, 0) AS INT)) AS frames FROM lineitem")
def j13(spark, sf):
    return B.read(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("fps"), C.scale_frames(10, F.col("l_quantity")).alias("frames")).distinct()


@register("j17_tile_origins", "SELECT p_partkey, least(i * 352, 1920 - 416) AS x0 FROM part, (SELECT unnest(range(0, 6)) AS i)")
def j17(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("p_partkey", F.least(F.col("i") * 352, F.lit(1920 - 416)).cast("long").alias("x0"))


@register("j21_regex_parse", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([0-9]+)(\\?|$)', 1) AS number FROM pages")
def j21(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", r"/([0-9]+)(\?|$)", 1).alias("number"))


@register("j22_vocabulary", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\bThe\\b', 'Das', 'g'), '(?i)\\bthe\\b', 'das', 'g')) AS digest FROM documents")
def j22(spark, sf):
    d = B.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(C.rewrite(F.col("text"), {"the": "das"})).alias("digest"))


@register("j25_nested_json", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS none FROM events")
def j25(spark, sf):
    e = B.read(spark, sf, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", F.coalesce(F.variant_get("v", "$.k", "int"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get("v", "$.none", "string"), F.lit("absent")).alias("none"))


@register("j26_durations", "SELECT event_id, (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text FROM (SELECT event_id, CAST(round_even(value * 60, 0) AS BIGINT) AS s FROM events)")
def j26(spark, sf):
    return B.read(spark, sf, "events").select("event_id", C.duration_text(F.col("value") * 60).alias("text"))


@register("j27_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def j27(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register(
    "j20_slug",
    """SELECT page_id, CASE WHEN base = url THEN base ELSE concat_ws('-', CASE WHEN base <> '' THEN base END, left(sha1(url), 8)) END AS slug FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS base FROM pages)""",
)
def j20(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", C.slug(F.col("url")).alias("slug"))


@register(
    "j23_prose",
    """SELECT run_id, array_to_string(list_filter([CASE WHEN n > 20 THEN 'You hit ' || n || ' shots.' END, CASE WHEN out_ > 5 THEN out_ || ' went out.' END, CASE WHEN out_ <= 5 THEN 'Few went out.' END], lambda z: z IS NOT NULL)[1:2], ' ') AS text
      FROM (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE call = 'OUT') AS out_ FROM front GROUP BY run_id)""",
)
def j23(spark, sf):
    m = B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("call") == "OUT").alias("out_"))
    parts = [F.when(F.col("n") > 20, F.format_string("You hit %d shots.", "n")), F.when(F.col("out_") > 5, F.format_string("%d went out.", "out_")), F.when(F.col("out_") <= 5, F.lit("Few went out."))]
    return m.select("run_id", C.prose(parts, 2).alias("text"))
