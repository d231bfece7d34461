"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row has a global number (its place in the order of id, text checksum and
size). The permutation maps numbers to places without a table: place p lies in
shard p mod n at slot p div n, so shards differ by one row at most, slots have
no gaps, and anyone can compute where row r went or which row lies at a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize, table

ROUNDS = 6


def _half_bits(n: int) -> int:
    bits = max(2, (max(n, 1) - 1).bit_length())
    return (bits + 1) // 2


def _round(right: np.ndarray, key: int, half: int) -> np.ndarray:
    h = (right ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h & np.uint64((1 << half) - 1)


def _keys(seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS)]


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each number below ``n``; walks the cycle while outside."""
    half, mask = _half_bits(n), np.uint64((1 << _half_bits(n)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in _keys(seed):
            left, right = right, left ^ _round(right, key, half)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The inverse of :func:`permute`: which row lies at a place."""
    half, mask = _half_bits(n), np.uint64((1 << _half_bits(n)) - 1)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in reversed(_keys(seed)):
            left, right = right ^ _round(left, key, half), left
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``row`` (a struct of the columns of ``rows``) and ``row_number`` from 0 in the order of ``order``; and the count of rows.

    The rows are range-partitioned once and written; what is left is one count
    per partition. A hash of the whole row breaks ties of ``order``. Equal rows
    are interchangeable, so an input position breaks theirs when ranges are cut,
    and a hot key spreads over many ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    keyed = rows.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)], F.xxhash64(*hashed).alias("hash"), F.monotonically_increasing_id().alias("tie"))
    keys = [F.col(c).asc_nulls_first() for c in keyed.columns[1:]]
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row")
    at = F.monotonically_increasing_id()
    placed = materialize(ranged.select("row", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    numbered = placed.join(F.broadcast(starts), "part")  # one row per range partition
    return numbered.select("row", (F.col("start") + F.col("at")).alias("row_number")), total


def assign_shards(rows: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number`` (long), ``shard`` (int) and ``slot`` (long); law ``rows``: shard sizes differ by one at most.

    The same rows, seed and number of shards give the same placement, however
    the input is partitioned: rows stand in the order of ``order``, then of a
    hash of all their columns. Nulls in ``order`` come first. Equal rows get
    places of their own. Columns of the three names are replaced, all others
    stay, whatever their names. An empty table gives an empty result.
    """
    given = [c for c in rows.columns if c not in ("row_number", "shard", "slot")]
    numbered, total = number_rows(rows.select(*[F.col(f"`{c}`") for c in given]), order)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), total, seed))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select("row.*", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    return assign_shards(rows, 16, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
