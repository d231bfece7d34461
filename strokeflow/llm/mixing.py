"""Mixing sources to target weights by weighted fair queueing.

Native: DataFrame functions only. Every shuffled document gets a virtual
finish time, the cumulative words of its source divided by the source's
target; the queue of all sources is cut where the total budget is reached.
No task ever holds a whole source: cumulative sums are taken in two levels
(sums by hash range, then within a range), and the global cut is found from
sums by range of virtual time before the rows of one single range are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

#: Words, as the contracts of this subpackage define them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a range of the shuffled order holds on average.
ROWS_PER_RANGE = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sizes`` (no_source, source, source_size) gains ``target``.

    Sources by code point, null last, take the weights in turn and share the
    whole budget (the sum of all sizes); no target exceeds ``max_repeats``
    times its source's size, and what that leaves goes to the others by
    weight. Sorted by size over weight, the capped sources are a prefix, so
    the level is found with prefix sums instead of repeated passes. One row
    per source is all that the global windows see.
    """
    rank = Window.orderBy("no_source", "source")
    fill = Window.orderBy(F.expr("source_size / weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(rank)).withColumn("weight", weight.cast("long"))
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    fits = F.col("left_words").cast("decimal(38,0)") * F.col("weight") <= F.col("source_size").cast("decimal(38,0)") * max_repeats * F.col("left_weight")
    s = s.withColumn("first_fit", F.min(F.when(fits, F.struct(F.expr("source_size / weight"), "rank", "left_words", "left_weight"))).over(everything))
    mine = F.struct(F.expr("source_size / weight"), F.col("rank"))
    level = F.struct(F.col("first_fit")["col1"], F.col("first_fit")["rank"])
    return s.select(
        "no_source", "source", "source_size",
        F.when(mine >= level, F.col("first_fit")["left_words"].cast("double") * F.col("weight") / F.col("first_fit")["left_weight"])
        .otherwise((max_repeats * F.col("source_size")).cast("double")).alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    ``taken`` is the document's size times the copies that the mix takes (0 to
    ``max_repeats``). The shuffled order within a source is that of the md5 of
    seed and doc_id, then of size, so reruns and other partitionings agree. Rows
    that are equal in doc_id, source and size, null ones too, are
    interchangeable: it is defined how many copies they get in all, not which of
    them. Null or empty texts have size 0; a source of such texts has target 0
    and takes nothing. Texts are read whole. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return _mixed(sizes, weights, max_repeats, seed).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _first_over(sums: DataFrame, by: str, start: int, budget: int) -> tuple[int, int] | None:
    """The first ``by`` at which the running sum of ``size`` from ``start`` passes ``budget``, and the sum before it."""
    upto = sums.withColumn("upto", F.sum("size").over(Window.orderBy(by)) + F.lit(start))
    found = upto.filter(F.col("upto") > budget).orderBy(by).select(by, (F.col("upto") - F.col("size")).alias("before")).first()
    return None if found is None else (found[by], found["before"])


def _mixed(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str) -> DataFrame:
    """``sizes`` (doc_id, source, size, and uid or nothing) with source_size, target and copies."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = materialize(
        sizes.select("*", key.alias("key"), F.col("source").isNull().cast("int").alias("no_source"), F.coalesce("source", F.lit("")).alias("src")), "mix-base"
    )
    ranges = max(1, base.count() // ROWS_PER_RANGE)
    base = base.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long"))
    sums = base.groupBy("no_source", "src", "range").agg(F.sum("size").alias("range_size"))
    in_source = Window.partitionBy("no_source", "src").orderBy("range")
    starts = sums.select(
        "no_source", "src", "range",
        (F.sum("range_size").over(in_source) - F.col("range_size")).alias("range_start"),
    )
    targets = source_targets(sums.groupBy("no_source", F.col("src").alias("source")).agg(F.sum("range_size").alias("source_size")), weights, max_repeats)
    starts = starts.join(targets.withColumnRenamed("source", "src"), ["no_source", "src"])
    within = Window.partitionBy("no_source", "src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = base.withColumn("running", F.sum("size").over(within)).join(starts, ["no_source", "src", "range"])
    queue = materialize(queue.withColumn("cumulative", F.col("range_start") + F.col("running")).drop("range", "range_start", "running"), "mix-queue")

    def finish(copy: Column) -> Column:
        return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("cumulative")).cast("double") / F.col("target"))

    slices = 16 * ranges
    slot = lambda time: F.floor(time * slices).cast("long")
    copies = queue.filter("target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"))
    copies = copies.withColumn("time", finish(F.col("copy"))).withColumn("slot", slot(F.col("time")))
    budget = queue.agg(F.sum("size")).first()[0] or 0
    # The cut is looked for among spans of slots, then among the slots of one span: two windows over about the square root of all slots.
    by_slot = materialize(copies.groupBy("slot").agg(F.sum("size").alias("size")), "mix-slots")
    wide = max(1, int(slices**0.5))
    spans = by_slot.groupBy(F.floor(F.col("slot") / wide).cast("long").alias("span")).agg(F.sum("size").alias("size"))
    cut = _first_over(spans, "span", 0, budget)
    if cut is not None:
        low = cut[0] * wide
        cut = _first_over(by_slot.filter(F.col("slot").between(low, low + wide - 1)), "slot", cut[1], budget)
    place = F.struct("time", "no_source", "src", "key", "size")
    if cut is None:
        taken = F.lit(max_repeats)
    else:
        ordered = copies.filter(F.col("slot") == cut[0]).select(place.alias("place"), "size")
        last = (
            ordered.withColumn("upto", F.sum("size").over(Window.orderBy("place")) + F.lit(cut[1]))
            .filter(F.col("upto") <= budget).agg(F.max("place").alias("place")).first()["place"]
        )

        def is_taken(copy: int) -> Column:
            time = finish(F.lit(copy))
            yes = slot(time) < cut[0]
            if last is not None:
                mine = F.struct(time.alias("time"), "no_source", "src", "key", "size")
                at = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("time", "double"), ("no_source", "int"), ("src", "string"), ("key", "string"), ("size", "long"))])
                yes = yes | ((slot(time) == cut[0]) & (mine <= at))
            return F.coalesce(yes, F.lit(False)).cast("int")

        taken = sum((is_taken(c) for c in range(1, max_repeats)), is_taken(0))
    return queue.select(*sizes.columns, "source_size", "target", taken.cast("int").alias("copies"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as :func:`mix_sources` takes it, with the columns of ``docs``, whatever their names.

    Rows are told apart by a number that they get when they are written, so
    repeated ones, null ids and all, meet in no group. Documents without words
    weigh nothing and are not taken.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "mix-rows")
    sizes = rows.select("row.doc_id", "row.source", word_count(F.col("row.text")).alias("size"), "uid")
    mixed = _mixed(sizes, weights, max_repeats, seed).filter("copies > 0 AND size > 0").select("uid", "copies")
    joined = rows.join(mixed.hint("shuffle_hash"), "uid")  # never a broadcast: ``mixed`` grows with the documents
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, CAST(source IS NULL AS INT) AS ns, coalesce(source, '') AS src, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), s0 AS (SELECT ns, src, CAST(sum(size) AS BIGINT) AS ss FROM base GROUP BY ns, src
), s1 AS (SELECT *, row_number() OVER (ORDER BY ns, src) AS rk FROM s0
), s2 AS (SELECT *, ((rk - 1) % 3) + 1 AS w FROM s1
), s3 AS (SELECT *, row_number() OVER (ORDER BY CAST(ss AS DOUBLE) / w, rk) AS o FROM s2
), s4 AS (SELECT *, sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lwt FROM s3
), lv AS (SELECT min(o) AS o FROM s4 WHERE lw * w <= 3 * ss * lwt
), t AS (SELECT a.ns, a.src, a.ss, CASE WHEN a.o >= lv.o THEN CAST(b.lw AS DOUBLE) * a.w / CAST(b.lwt AS DOUBLE) ELSE CAST(3 * a.ss AS DOUBLE) END AS target
  FROM s4 a, lv, s4 b WHERE b.o = lv.o
), q AS (SELECT base.*, t.ss, t.target, sum(size) OVER (PARTITION BY base.ns, base.src ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM base JOIN t ON base.ns = t.ns AND base.src = t.src
), c AS (SELECT q.*, CAST(e.e * ss + cum AS DOUBLE) / target AS vt FROM q, (SELECT unnest([0, 1, 2]) AS e) e WHERE target > 0
), r AS (SELECT *, sum(size) OVER (ORDER BY vt, ns, src, k, size RANGE UNBOUNDED PRECEDING) AS upto FROM c
), ok AS (SELECT doc_id, ns, src, k, size, cum, count(*) AS n FROM r WHERE upto <= (SELECT sum(size) FROM base) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.ss AS source_size, q.target, CAST(q.size * coalesce(ok.n, 0) AS BIGINT) AS taken
FROM q LEFT JOIN (SELECT DISTINCT * FROM ok) ok ON q.doc_id IS NOT DISTINCT FROM ok.doc_id AND q.ns = ok.ns AND q.src = ok.src AND q.k = ok.k AND q.size = ok.size AND q.cum = ok.cum
"""
