"""Queries over sets, dedup, sampling and ranking (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..operators import sets as S
from . import bindings as B


@register("h02_top_two_by_confidence", "SELECT run_id, frame, rank FROM (SELECT run_id, frame, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, frame) AS rank FROM track) WHERE rank <= 2")
def h02(spark, sf):
    return S.top_n(B.track(spark, sf).select("run_id", "frame", "confidence"), ["run_id"], [F.desc("confidence"), F.col("frame")], 2).drop("confidence")


@register("h03_newest_with_analytics", "SELECT run_id, n FROM (SELECT run_id, max(event_id) AS created, count(*) FILTER (WHERE event_type = 'wall') AS n FROM hits GROUP BY run_id) WHERE n >= 20 ORDER BY created DESC, run_id DESC LIMIT 8")
def h03(spark, sf):
    per = B.hits(spark, sf).groupBy("run_id").agg(F.max("event_id").alias("created"), F.count_if(F.col("event_type") == "wall").alias("n"))
    return per.filter("n >= 20").orderBy(F.desc("created"), F.desc("run_id")).limit(8).select("run_id", "n")


@register(
    "h05_advice_rules",
    """WITH m AS (SELECT run_id, count(*) AS n, avg(y) AS h, avg(CASE WHEN x BETWEEN 0.21 AND 0.79 THEN 1 ELSE 0 END) AS c, max(speed_before) AS s FROM front GROUP BY run_id),
      r AS (SELECT run_id, 'aim wider' AS advice, 3 AS priority, 1 AS o FROM m WHERE n >= 6 AND c > 0.55 UNION ALL SELECT run_id, 'hit higher', 2, 2 FROM m WHERE n >= 6 AND h > 0.1 UNION ALL SELECT run_id, 'more pace', 1, 3 FROM m WHERE n >= 6 AND s < 60)
      SELECT run_id, advice, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, o) AS rank FROM r) WHERE rank <= 2""",
)
def h05(spark, sf):
    m = B.hits(spark, sf).filter(C.front_wall(F.col("event_type"))).groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg("y").alias("h"), F.avg(F.col("x").between(0.21, 0.79).cast("int")).alias("c"), F.max("speed_before").alias("s")
    )
    rule = lambda cond, text, p, o: F.when((F.col("n") >= 6) & F.expr(cond), F.struct(F.lit(text).alias("advice"), F.lit(p).alias("priority"), F.lit(o).alias("o")))
    rules = F.array_compact(F.array(rule("c > 0.55", "aim wider", 3, 1), rule("h > 0.1", "hit higher", 2, 2), rule("s < 60", "more pace", 1, 3)))
    return S.top_n(m.select("run_id", F.inline(rules)), ["run_id"], [F.desc("priority"), F.col("o")], 2).select("run_id", "advice", "rank")


@register("i01_union_by_name", "SELECT run_id, frame, call, NULL::DOUBLE AS confidence FROM hits UNION ALL SELECT run_id, frame, NULL, confidence FROM track WHERE NOT detected")
def i01(spark, sf):
    return B.hits(spark, sf).select("run_id", "frame", "call").unionByName(B.track(spark, sf).filter("NOT detected").select("run_id", "frame", "confidence"), allowMissingColumns=True)


@register(
    "i02_label_dilation",
    "WITH b AS (SELECT run_id, min(frame) AS low, max(frame) AS high FROM hits GROUP BY run_id) SELECT DISTINCT run_id, unnest(range(greatest(frame - 2, low), least(frame + 2, high) + 1)) AS frame FROM hits JOIN b USING (run_id) WHERE event_type = 'racket'",
)
def i02(spark, sf):
    labels = B.bounded(B.hits(spark, sf)).filter("event_type = 'racket'")
    return S.dilate(labels, 2, F.col("first_frame"), F.col("last_frame"))


@register("i03_set_difference", "SELECT run_id, frame FROM hits EXCEPT SELECT run_id, frame FROM front")
def i03(spark, sf):
    h = B.hits(spark, sf)
    return h.select("run_id", "frame").subtract(h.filter(C.front_wall(F.col("event_type"))).select("run_id", "frame"))


@register(
    "i04_dedup_corrections",
    """SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'run' || o_orderkey ELSE 'sha' || o_custkey END || '/' || (o_orderkey % 50) AS k, o_orderdate FROM orders) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def i04(spark, sf):
    o = B.read(spark, sf, "orders")
    who = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("run"), "o_orderkey")).otherwise(F.concat(F.lit("sha"), "o_custkey"))
    keyed = o.select("o_orderkey", F.concat(who, F.lit("/"), (F.col("o_orderkey") % 50).cast("string")).alias("k"), "o_orderdate")
    return S.latest(keyed, [F.col("k")], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "k")


@register(
    "i05_largest_session",
    """WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber DESC) = 1)
      SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem JOIN b USING (l_suppkey, l_linenumber) GROUP BY ALL""",
)
def i05(spark, sf):
    li = B.read(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey")
    return S.largest_session(li, "l_suppkey", "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@register("i06_merge_cases", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN call ELSE 'old' END AS call FROM hits")
def i06(spark, sf):
    h = B.hits(spark, sf).select("event_id", "call")
    new = h.filter("event_id % 3 = 0")
    return new.unionByName(h.select("event_id", F.lit("old").alias("call")).join(new, "event_id", "left_anti"))


@register(
    "i08_negative_sampling",
    """WITH ex AS (SELECT DISTINCT run_id, unnest(range(frame - 2, frame + 3)) AS frame FROM hits WHERE event_type = 'racket') SELECT run_id, frame FROM hits h WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.run_id = h.run_id AND ex.frame = h.frame)
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY md5('negatives-' || run_id || '-' || frame)) <= 6""",
)
def i08(spark, sf):
    h = B.hits(spark, sf)
    return S.negatives(h.select("run_id", "frame"), h.filter("event_type = 'racket'"), 2, 6)


@register(
    "i09_stratified_split",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('split-' || event_id), event_id) <= round(count(*) OVER (PARTITION BY event_type) * 0.25) AS is_test FROM hits",
)
def i09(spark, sf):
    return S.stratified_split(B.hits(spark, sf).select("event_id", "event_type"), "event_type", "event_id", 0.25).select("event_id", "is_test")
