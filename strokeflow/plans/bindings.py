"""Deterministic projections of the driver's tables into the engine's entities, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame, t (hours), event_id, event_type, k, x, y, call, speed_before, speed_after; one run per user, an hour counts as a second."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for x in ("view", "wall", "click", "wall", "purchase", "floor", "signup", "racket", "error", "side_wall")])
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return e.select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("frame"),
        (us / F.lit(3600000000)).alias("t"),
        "event_id",
        F.element_at(kind, F.col("event_type")).alias("event_type"),
        k.alias("k"),
        ((k + 0.5) / 100).alias("x"),
        (F.col("value") / 500).alias("y"),
        F.when(k % 10 == 0, None).when((k % 7).isin(1, 2), "OUT").otherwise("IN").alias("call"),
        (F.col("value") * 0.3).alias("speed_before"),
        (F.col("value") * 0.2).alias("speed_after"),
    )


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` with the first_frame and last_frame of their run."""
    w = Window.partitionBy("run_id")
    return rows.withColumn("first_frame", F.min("frame").over(w)).withColumn("last_frame", F.max("frame").over(w))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame (with gaps), t, x, y, width, height, detected, confidence; one run per supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = F.row_number().over(w).cast("long")
    li = read(spark, sf_dir, "lineitem").withColumn("n", n)
    frame = F.col("n") + F.floor(F.col("n") / 5) * 3
    seen = F.col("l_returnflag") != "R"
    return li.select(
        F.col("l_suppkey").alias("run_id"),
        frame.alias("frame"),
        (frame / F.lit(60)).alias("t"),
        F.when(seen, F.col("l_extendedprice") / 100).alias("x"),
        F.when(seen, F.col("l_quantity") * 20).alias("y"),
        (F.col("l_linenumber") + 2).cast("double").alias("width"),
        ((F.col("l_partkey") % 5) + 2).cast("double").alias("height"),
        seen.alias("detected"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, track, t, x_ft, y_ft, coasted: two players per supplier."""
    side = F.col("l_partkey") % 2
    w = Window.partitionBy("l_suppkey", side).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.when(side == 0, "A").otherwise("B").alias("track"),
        (F.row_number().over(w) / F.lit(4)).alias("t"),
        (F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(2100)) / F.lit(100)).alias("x_ft"),
        (F.col("l_quantity") * 0.64).alias("y_ft"),
        (F.col("l_linestatus") == "F").alias("coasted"),
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, cal: one per supplier; every other one has corners, every tenth one nothing."""
    k = F.col("s_suppkey")
    num = lambda c: c.cast("double")
    line = lambda *v: F.struct(*[num(c).alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"))])
    point = lambda x, y: F.struct(num(x).alias("x"), num(y).alias("y"))
    top = line(20 + k % 7 * 5, 150 + k % 5 * 10, 1000 - k % 3 * 30, 170 - k % 4 * 10)
    bottom = line(30 + k % 4 * 10, 800 + k % 6 * 10, 980 + k % 5 * 4, 820 - k % 7 * 10)
    service = line(F.lit(25), 480 + k % 3 * 10, F.lit(990), 500 - k % 3 * 10)
    corners = F.struct(point(F.lit(40), F.lit(150)).alias("tl"), point(960 - k % 3 * 20, F.lit(160)).alias("tr"), point(F.lit(990), F.lit(850)).alias("br"), point(10 + k % 3 * 10, F.lit(860)).alias("bl"))
    known = k % 10 != 0
    cal = F.struct(F.when(known, top).alias("top"), F.when(known, bottom).alias("bottom"), F.when(known, service).alias("service"), F.when(known & (k % 2 == 1), corners).alias("corners"))
    return read(spark, sf_dir, "supplier").select(k.alias("run_id"), cal.alias("cal"))


#: The same projections for DuckDB, by entity.
ENTITIES = {
    "hits": """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
      (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS t, event_id,
      CASE event_type WHEN 'view' THEN 'wall' WHEN 'click' THEN 'wall' WHEN 'purchase' THEN 'floor' WHEN 'signup' THEN 'racket' WHEN 'error' THEN 'side_wall' END AS event_type,
      CAST(json_extract_string(props, '$.k') AS INT) AS k, (CAST(json_extract_string(props, '$.k') AS INT) + 0.5::DOUBLE) / 100 AS x, value / 500 AS y,
      CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN NULL WHEN CAST(json_extract_string(props, '$.k') AS INT) % 7 IN (1, 2) THEN 'OUT' ELSE 'IN' END AS call,
      value * 0.3::DOUBLE AS speed_before, value * 0.2::DOUBLE AS speed_after FROM events""",
    "track": """SELECT l_suppkey AS run_id, n + (n // 5) * 3 AS frame, (n + (n // 5) * 3) / 60.0::DOUBLE AS t,
      CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 100 END AS x, CASE WHEN l_returnflag <> 'R' THEN l_quantity * 20 END AS y,
      CAST(l_linenumber + 2 AS DOUBLE) AS width, CAST(l_partkey % 5 + 2 AS DOUBLE) AS height, l_returnflag <> 'R' AS detected, round(l_discount * 10, 2) AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem)""",
    "samples": """SELECT l_suppkey AS run_id, CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS track,
      row_number() OVER (PARTITION BY l_suppkey, l_partkey % 2 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) / 4.0::DOUBLE AS t,
      (CAST(round(l_extendedprice * 100) AS BIGINT) % 2100) / 100.0::DOUBLE AS x_ft, l_quantity * 0.64::DOUBLE AS y_ft, l_linestatus = 'F' AS coasted FROM lineitem""",
    "calibrations": """SELECT k AS run_id, (20 + k % 7 * 5)::DOUBLE AS tx0, (150 + k % 5 * 10)::DOUBLE AS ty0, (1000 - k % 3 * 30)::DOUBLE AS tx1, (170 - k % 4 * 10)::DOUBLE AS ty1,
      (30 + k % 4 * 10)::DOUBLE AS bx0, (800 + k % 6 * 10)::DOUBLE AS by0, (980 + k % 5 * 4)::DOUBLE AS bx1, (820 - k % 7 * 10)::DOUBLE AS by1,
      25::DOUBLE AS sx0, (480 + k % 3 * 10)::DOUBLE AS sy0, 990::DOUBLE AS sx1, (500 - k % 3 * 10)::DOUBLE AS sy1, k % 10 <> 0 AS known, k % 2 = 1 AND k % 10 <> 0 AS cornered,
      (960 - k % 3 * 20)::DOUBLE AS trx, (10 + k % 3 * 10)::DOUBLE AS blx FROM (SELECT s_suppkey AS k FROM supplier)""",
    "front": "SELECT * FROM hits WHERE event_type IS NULL OR event_type = 'wall'",
    "gaps": "SELECT * FROM (SELECT run_id, frame, t, t - lag(t) OVER (PARTITION BY run_id ORDER BY frame) AS gap FROM front) WHERE gap > 0",
    "pairs": """SELECT run_id, gap AS low, lead(gap) OVER (PARTITION BY run_id ORDER BY gap, frame) AS high FROM gaps""",
    "split": """SELECT r.run_id, coalesce(p.threshold, 5.0) AS threshold FROM (SELECT DISTINCT run_id FROM front) r LEFT JOIN (
      SELECT run_id, (low + high) / 2 AS threshold FROM pairs WHERE high >= 4 AND high >= 1.75 * low QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY high / low DESC, low) = 1) p ON r.run_id = p.run_id""",
    "rally_hits": """SELECT *, row_number() OVER (PARTITION BY run_id, rally_number ORDER BY frame) AS rally_hit_sequence, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS sequence
      FROM (SELECT h.*, 1 + sum(CASE WHEN h.gap >= s.threshold THEN 1 ELSE 0 END) OVER (PARTITION BY h.run_id ORDER BY h.frame) AS rally_number
      FROM (SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY frame) AS gap FROM front) h JOIN split s USING (run_id))""",
    "rallies": """SELECT run_id, rally_number, min(frame) AS start_frame, max(frame) AS end_frame, min(t) AS start_t, max(t) AS end_t, count(*) AS n_hits,
      max(CASE WHEN rally_hit_sequence = 1 THEN call END) AS serve_call, max(CASE WHEN last_ THEN call END) AS last_call
      FROM (SELECT *, rally_hit_sequence = count(*) OVER (PARTITION BY run_id, rally_number) AS last_ FROM rally_hits) GROUP BY run_id, rally_number""",
}


def with_entities(sql: str) -> str:
    """``sql`` after common table expressions for the entities that it names."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in ENTITIES:
            if re.search(rf"\b{name}\b", text) and name not in wanted and text is not ENTITIES[name]:
                add(ENTITIES[name])
                if name not in wanted:
                    wanted.append(name)

    add(sql)
    if not wanted:
        return sql
    body = sql.strip()
    ctes = ", ".join(f"{n} AS ({ENTITIES[n]})" for n in wanted)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes}, {body[len(head) :]}"
    return f"WITH {ctes} {body}"
