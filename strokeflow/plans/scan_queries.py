"""Queries over the scan rules (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..sources import files as S
from . import bindings as B


def rows(spark, sf):
    return B.track(spark, sf).withColumn("seq", F.col("frame")).withColumn("x", F.floor(F.col("x") / 300)).withColumn("y", F.floor(F.col("y") / 400))


@register(
    "a01_kept_positions",
    """SELECT run_id, frame, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM (SELECT run_id, frame, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT run_id, frame, floor(x / 300) AS x, floor(y / 400) AS y FROM track WHERE detected) WINDOW w AS (PARTITION BY run_id ORDER BY frame)) WHERE px IS NULL OR px <> x OR py <> y""",
)
def a01(spark, sf):
    return S.kept_positions(rows(spark, sf)).select("run_id", "frame", "x", "y")


@register("a02_last_row_per_frame", "SELECT run_id, frame // 4 AS frame, max(frame) AS seq FROM track GROUP BY ALL")
def a02(spark, sf):
    t = B.track(spark, sf).select("run_id", F.col("frame").alias("seq"), F.floor(F.col("frame") / 4).alias("frame"))
    return S.last_per_frame(t)


@register(
    "a04_label_normalisation",
    """WITH l AS (SELECT run_id, event_id AS seq, frame // 2 AS frame, CASE WHEN k % 5 = 0 THEN NULL WHEN event_type = 'side_wall' THEN ' SideWall' WHEN k % 11 = 0 THEN 'bogus' ELSE upper(event_type) END AS type FROM hits),
      n AS (SELECT run_id, seq, frame, CASE WHEN lower(trim(coalesce(type, 'wall'))) = 'sidewall' THEN 'side_wall' ELSE lower(trim(coalesce(type, 'wall'))) END AS type FROM l)
      SELECT run_id, frame, type FROM n WHERE type IN ('wall', 'side_wall', 'floor', 'racket') QUALIFY row_number() OVER (PARTITION BY run_id, frame ORDER BY seq DESC) = 1""",
)
def a04(spark, sf):
    h = B.hits(spark, sf)
    kind = F.when(F.col("k") % 5 == 0, None).when(F.col("event_type") == "side_wall", " SideWall").when(F.col("k") % 11 == 0, "bogus").otherwise(F.upper("event_type"))
    return S.normal_labels(h.select("run_id", F.col("event_id").alias("seq"), F.floor(F.col("frame") / 2).alias("frame"), kind.alias("type"))).select("run_id", "frame", "type")


@register("b07_upsert_by_frame", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'old' END AS payload FROM events WHERE event_id % 5 <> 0 OR event_id % 3 <> 0")
def b07(spark, sf):
    e = B.read(spark, sf, "events")
    new = e.filter("event_id % 5 = 0").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("payload"))
    return S.upsert(e.select("event_id", F.lit("old").alias("payload")), new, ["event_id"])


@register("b15_one_row_at_least", "SELECT run_id, f AS frame, event_id FROM (SELECT DISTINCT run_id, frame // 3 AS f FROM hits) LEFT JOIN (SELECT run_id, frame // 3 AS f, event_id FROM hits WHERE event_type = 'floor') USING (run_id, f)")
def b15(spark, sf):
    h = B.hits(spark, sf).withColumn("f", F.floor(F.col("frame") / 3))
    boxes = F.collect_list(F.when(F.col("event_type") == "floor", F.col("event_id")))
    return h.groupBy("run_id", "f").agg(boxes.alias("boxes")).select("run_id", F.col("f").alias("frame"), F.explode_outer("boxes").alias("event_id"))
