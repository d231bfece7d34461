"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Two sets of sizes a and b with a Jaccard similarity of at least t share at
least t (a + b) / (1 + t) n-grams. Documents with the same set become one class
first. The n-grams of all classes stand in one global order, the commonest
last. Two linked classes then share an n-gram among the first n - ceil(t n) + 1
of each; the rows of the incidence matrix that fall into one such column form a
block. Within a block, the places of the shared n-gram in both orders bound the
overlap, and pairs below the bound that their sizes set are discarded. What is
left is multiplied out: the row of one class times the rows of all classes that
it meets, accumulating overlap counts over all columns. (Which n-grams count as
common affects speed alone: any order gives the same links.)

Near copies meet in as many large blocks as they share n-grams, so large blocks
with the same first member are bundled: a bundle has a row per class, with a
bit for each of its blocks, and a pair is looked at once in a bundle, at the
first block that it shares. Within a bundle not all pairs are looked at, where
only components are asked for: a few leaders, the members that are in most of
its blocks, are compared with the rest, and only members that are still in
different components meet further leaders, in rounds with eight times as many,
until none are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles
from .components import components
from .storage import batches_of, discard, materialize, table
from .textarrays import U, mix

#: Blocks of up to so many classes are multiplied out at once.
SMALL = 8
#: Blocks of a bundle at most: bits of a long without its sign.
BUNDLED = 63
#: N-grams in at least this many classes come last in the order, the commonest MAX_COMMON of them (a bound on what is broadcast: 12 bytes each).
COMMON = 16
MAX_COMMON = 1_000_000
#: Counting n-grams: bits that tell them apart, n-grams that a task gathers before it deals them out, n-grams that a part should hold.
COUNTED_BITS = 40
GATHERED = 1 << 19
PART = 1 << 18
#: Bits of the filter that keeps sets without a candidate at home.
FILTER_BITS = 1 << 26
#: Rows of the table of where sets go up to which it is broadcast (of four numbers each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a leader that one group compares.
GROUP = 2000
#: Sets, and parcels of n-grams to be counted, that a task gets in a batch.
BATCH = 2000
PARCELS = 200
#: N-grams that a task works on at a time (a longer set comes alone).
CHUNK = 1 << 18
#: Sets that a task remembers having emitted.
HELD = 1 << 19

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("grams", pa.binary())])
_COLUMN = pa.schema([("gram", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(t n): n-grams that any partner shares at least."""
    return -(-n * num // den)


def _ids(h: np.ndarray, of: np.ndarray, row: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit fingerprint, in two numbers, of each set."""
    n = np.bincount(of - row, minlength=end - row)
    total = [np.concatenate([[U(0)], np.cumsum(mix(h ^ U(salt)))]) for salt in (0x5BD1E995, 0x2545F491)]
    border = np.concatenate([[0], np.cumsum(n)])
    a, b = (mix((t[border[1:]] - t[border[:-1]]) + n.astype(U)) for t in total)
    return n, a.view(np.int64), b.view(np.int64)


def _parity(h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Per set a bitmap of about as many bits as it has members: how often, odd or even, members fall on each."""
    out, at = [], 0
    for size in n.tolist():
        bits = max(64, 1 << max(0, size - 1).bit_length())
        place = ((h[at : at + size] >> U(20)) & U(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes() if size else None)
        at += size
    return out


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """A row per document: size, fingerprint, parity bitmap and sorted n-grams of its set, its ``text_id`` if ``docs`` have one, and a number ``row``."""
    keyed = "text_id" in docs.columns
    schema = _SETS.append(pa.field("text_id", pa.int64())) if keyed else _SETS

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, of in shingles.batches(batch["text"], k):
                n, a, b = _ids(h, of, row, end)
                border = np.concatenate([[0], np.cumsum(n)]) * 8
                body = h.tobytes()
                bodies = [body[i:j] for i, j in zip(border[:-1], border[1:])]
                own = [batch["text_id"][row:end]] if keyed else []
                columns = [pa.array(n), pa.array(a), pa.array(b), pa.array(_parity(h, n), pa.binary()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][row:end], *columns, *own], schema=schema)

    types = "doc_id long, n long, set_id long, check long, bits binary, grams binary" + (", text_id long" if keyed else "")
    return docs.mapInArrow(describe, types).withColumn("row", F.monotonically_increasing_id())


def _incidence(batch: pa.RecordBatch, seen: _Seen) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes and n-grams (end to end) of the sets of a batch that are not empty and not yet ``seen``, in parts of about CHUNK n-grams."""
    ids, n = batch["set_id"].to_numpy(), batch["n"].to_numpy()
    rows = np.flatnonzero(seen.new(ids, n > 0))
    grams = batch["grams"]
    part = np.cumsum(n[rows]) // CHUNK
    for some in np.split(rows, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(rows) else []:
        yield ids[some], n[some], np.concatenate([np.frombuffer(grams[int(i)].as_buffer(), U) for i in some])


class _Seen:
    """Sets that a task has emitted; forgets all beyond HELD, which costs repeated rows and nothing else."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def new(self, ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if len(self.seen) > HELD:
            self.seen.clear()
        out = np.zeros(len(ids), bool)
        for i in np.flatnonzero(wanted):
            x = int(ids[i])
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's ``times``."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(times, start) if len(start) else times


def _gram_counts(sets: DataFrame, least: int) -> DataFrame:
    """(gram, n) for the n-grams (by their upper COUNTED_BITS bits) that at least ``least`` sets hold, counted over all sets.

    A set whose copies several tasks read counts in each of them, which only moves it in the order.
    N-grams are dealt out by their upper bits in packed form, four bytes each;
    a task counts one part at a time, and there are as many parts as it takes
    to keep one near PART n-grams.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    part_bits = min(COUNTED_BITS, max(COUNTED_BITS - 32, int(total // PART).bit_length()))
    low = U(COUNTED_BITS - part_bits)
    schema = pa.schema([("part", pa.int64()), ("once", pa.binary()), ("many", pa.binary()), ("times", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Seen(), [], 0

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(start, len(h))).astype(np.uint32)
            h = h[start]
            part, key = (h >> low).astype(np.int64), (h & ((U(1) << low) - U(1))).astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rows = []
            for i, j in zip(first, np.append(first[1:], len(h))):
                k, t = key[i:j], times[i:j]
                rows.append((int(part[i]), k[t == 1].tobytes(), k[t > 1].tobytes(), t[t > 1].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for _, _, h in _incidence(batch, seen):
                held.append(h >> U(64 - COUNTED_BITS))
                size += len(h)
                if size >= GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []

        def sums() -> pa.RecordBatch:
            once, many, times = (np.frombuffer(b"".join(r[i] for r in rows), np.uint32) for i in range(3))
            k = np.sort(once)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            t = np.diff(np.append(start, len(k)))
            k = k[start]
            many, times = _sums(many, times.astype(np.int64))
            # Most n-grams occur once in all; they need no second sort.
            some = t > 1
            if len(many):
                some |= many[np.minimum(np.searchsorted(many, k), len(many) - 1)] == k
            k, t = _sums(np.concatenate([k[some], many]), np.concatenate([t[some], times]))
            k, t = k[t >= least], t[t >= least]
            return pa.RecordBatch.from_arrays([pa.array(((U(number) << low) | k.astype(U)).view(np.int64)), pa.array(t.astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for part, *blobs in zip(*(batch[c].to_pylist() for c in ("part", "once", "many", "times"))):
                if part != number and rows:
                    yield sums()
                    rows = []
                number = part
                rows.append(blobs)
        if rows:
            yield sums()

    dealt = sets.select("set_id", "n", "grams").mapInArrow(deal, "part long, once binary, many binary, times binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "gram long, n long")


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common n-grams (their upper bits, sorted) and the place of each in the order by frequency; at most MAX_COMMON."""
    with batches_of(sets.sparkSession, PARCELS):
        counts = materialize(_gram_counts(sets, COMMON), "join-counts")
    # The least frequency whose n-grams are not too many: one row per frequency, of which few are large.
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(F.log2("n")) * 4096)
    levels = sorted(((r["level"], r["m"]) for r in counts.groupBy(level.cast("long").alias("level")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, held = None, 0
    for at, m in levels:
        held += m
        if held > MAX_COMMON:
            break
        least = at
    found = counts.filter(level >= least).toPandas() if least is not None else None
    discard(counts)
    if found is None:
        return np.zeros(0, U), np.zeros(0, np.int32)
    keys = found.gram.to_numpy(np.int64).view(U)
    by_key = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, found.n.to_numpy()))] = np.arange(len(keys), dtype=np.int32)
    return keys[by_key], rank[by_key]


def _first(h: np.ndarray, n: np.ndarray, wanted: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of ``n`` sorted n-grams ``h``, the first ``wanted`` of each in the global order: indices into h, set, place. Rare ones come first, by hash; then common ones, by rank."""
    of = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    if len(keys):
        t = h >> U(64 - COUNTED_BITS)
        at = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
        common = keys[at] == t
    else:
        at, common = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    upto = np.concatenate([[0], np.cumsum(~common)])
    place = upto[:-1] - upto[begin][of]
    rare = upto[begin + n] - upto[begin]
    i = np.flatnonzero(~common & (place < wanted[of]))
    j = np.flatnonzero(common & (rare < wanted)[of])
    j = j[np.lexsort((h[j], rank[at[j]], of[j]))]
    o = of[j]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    within = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    p = rare[o] + within
    ok = p < wanted[o]
    return np.concatenate([i, j[ok]]), np.concatenate([of[i], o[ok]]), np.concatenate([place[i], p[ok]])


def _first_grams(sets: DataFrame, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, set_id, n, pos) for the first n-grams of each set."""
    held = sets.sparkSession.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for ids, n, h in _incidence(batch, seen):
                i, of, place = _first(h, n, n - _least(n, num, den) + 1, *held.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i].view(np.int64)), pa.array(ids[of]), pa.array(n[of].astype(np.int32)), pa.array(place.astype(np.int32))], schema=_COLUMN
                )

    return sets.select("set_id", "n", "grams").mapInArrow(emit, "gram long, set_id long, n int, pos int")


def _blocks(columns: DataFrame, num: int, den: int) -> DataFrame:
    """Rows by gram to pairs of small blocks (gram null) and members of large ones (v null; rank from 0 in the order of pos and set_id)."""
    schema = pa.schema([("gram", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("rank", pa.int64())])

    def pairs(g: np.ndarray, s: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        us, vs = [], []
        for d in range(1, SMALL):
            most = np.minimum(n[d:] - p[d:], n[:-d] - p[:-d]).astype(np.int64)
            ok = (g[d:] == g[:-d]) & (most * (num + den) >= (n[d:] + n[:-d]).astype(np.int64) * num)
            us.append(np.minimum(s[:-d], s[d:])[ok])
            vs.append(np.maximum(s[:-d], s[d:])[ok])
        return np.concatenate(us), np.concatenate(vs)

    def rows(gram, u, v=None, n=None, pos=None, rank=None) -> pa.RecordBatch:
        given = (gram, u, v, n, pos, rank)
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), f.type) if x is None else pa.array(x, f.type) for x, f in zip(given, schema)], schema=schema)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of blocks that may go on in the next batch
        begun = None  # a large block that is being passed through: its gram, its next rank, its last set

        def work(g, s, n, p, last: bool):
            """Rows of the blocks of sorted rows; the last block is held back unless ``last``, or passed through if it is large."""
            nonlocal begun
            out = []
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            if begun is not None and len(g) and begun[0] == g[0] and begun[2] == s[0]:
                new[0] = False
            g, s, n, p = g[new], s[new], n[new], p[new]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(g)))
            first = np.zeros(len(size), np.int64)
            if begun is not None and len(g):
                if begun[0] == g[0]:
                    first[0] = begun[1]
                else:
                    begun = None
            many = size + first > SMALL
            keep = tuple(x[:0] for x in (g, s, n, p))
            if len(g) and not last and not many[-1]:
                at = start[-1]
                keep = (g[at:], s[at:], n[at:], p[at:])
                g, s, n, p, start, size, first, many = g[:at], s[:at], n[:at], p[:at], start[:-1], size[:-1], first[:-1], many[:-1]
            large = np.repeat(many, size)
            if (~large).any():
                u, v = pairs(*(x[~large] for x in (g, s, n, p)))
                if len(u):
                    out.append(rows(None, u, v))
            if large.any():
                rank = np.arange(len(g)) - np.repeat(start - first, size)
                out.append(rows(g[large], s[large], None, n[large], p[large], rank[large]))
                if many[-1]:
                    begun = (g[-1], int(size[-1] + first[-1]), s[-1])
            return keep, out

        for batch in batches:
            now = [batch[c].to_numpy() for c in ("gram", "set_id", "n", "pos")]
            if held is not None:
                now = [np.concatenate([a, b]) for a, b in zip(held, now)]
            held, out = work(*now, False)
            yield from out
        if held is not None:
            yield from work(*held, True)[1]

    dealt = columns.repartition("gram").sortWithinPartitions("gram", "pos", "set_id")
    return dealt.mapInArrow(block, "gram long, u long, v long, n int, pos int, rank long")


def _bodies(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, grams) of the sets that ``wanted`` (set_id) names, and a few more."""
    slots = FILTER_BITS // 64
    bit = F.shiftrightunsigned(F.col("set_id"), 38)  # the upper 26 bits
    words = (
        wanted.groupBy(F.floor(bit / 64).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(set_id, 38), 64) as int))")).alias("bits"))
        .toPandas()
    )  # at most FILTER_BITS / 64 rows
    bits = np.zeros(slots, np.int64)
    bits[words.slot] = words.bits
    held = sets.sparkSession.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = _Seen(), held.value.view(U)
        for batch in batches:
            ids = batch["set_id"].to_numpy()
            at = ids.view(U) >> U(38)
            new = seen.new(ids, ((bits[at >> U(6)] >> (at & U(63))) & U(1)).astype(bool))
            if new.any():
                yield batch.filter(pa.array(new))

    return sets.filter("n > 0").select("set_id", "grams").mapInArrow(emit, "set_id long, grams binary")


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` without those that their parity bitmaps rule out.

    Sets differ in at least as many members as their bitmaps differ in bits;
    the larger bitmap folds onto the smaller.
    """
    of = lambda c: classes.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = zip(batch["nu"].to_pylist(), batch["nv"].to_pylist())
            for i, ((a, b), x, y) in enumerate(zip(sizes, batch["bitsu"], batch["bitsv"])):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                m = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, m), axis=0) for z in (x, y))
                overlap = (a + b - int(np.bitwise_count(x ^ y).sum())) // 2
                keep[i] = den * overlap >= num * (a + b - overlap)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(pa.array(keep)), batch["v"].filter(pa.array(keep))], schema=schema)

    return pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(rule, "u long, v long")


def _verify(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v, overlap) among ``pairs``: each leader's row times the rows of its members, group by group, in overlap counts over all columns."""
    groups = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(groups, "u").select(F.col("v").alias("set_id"), "u", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int").alias("group"), "v")
    leaders = groups.select(F.col("u").alias("set_id"), "u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("v"))
    # Where each set is to go: a set moves once for each group that it is in.
    wanted = materialize(leaders.unionByName(members), "join-wanted")
    bodies = _bodies(sets, wanted.select("set_id"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sent = bodies.join(F.broadcast(wanted), "set_id")
    else:
        sent = bodies.groupBy("set_id").agg(F.first("grams").alias("grams")).join(wanted, "set_id")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("overlap", pa.int64())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, U)
        for batch in batches:
            us, vs, grams = batch["u"].to_pylist(), batch["v"].to_pylist(), batch["grams"]
            found, at = [], 0
            while at < len(us):
                if vs[at] is None:
                    lead, own = us[at], np.frombuffer(grams[at].as_buffer(), U).copy()
                    at += 1
                    continue
                end = at
                while end < len(us) and us[end] == lead and vs[end] is not None:
                    end += 1
                assert end > at
                rows = [np.frombuffer(grams[i].as_buffer(), U) for i in range(at, end)]
                n = np.array([len(r) for r in rows])
                columns = np.concatenate(rows)
                hit = own[np.minimum(np.searchsorted(own, columns), len(own) - 1)] == columns
                overlap = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                ok = den * overlap >= num * (len(own) + n - overlap)
                found += [(lead, vs[at + i], int(overlap[i])) for i in np.flatnonzero(ok)]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], schema=schema)

    dealt = sent.select("u", "group", "v", "grams").repartition("u", "group").sortWithinPartitions("u", "group", F.col("v").asc_nulls_first())
    return dealt.mapInArrow(multiply, "u long, v long, overlap long").distinct()  # a set that copies of it sent twice


def _rekeyed(sets: DataFrame) -> DataFrame:
    """``sets`` where a set_id that different sets share, by its other half, gives way to that half; so sets are told apart by 128 bits.

    Shared 64-bit numbers are as good as none below 10^9 sets, and expected to
    be some hundreds at 10^11.
    """
    shared = sets.filter("n > 0").groupBy("set_id").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").select("set_id").collect()
    if not shared:
        return sets
    return sets.withColumn("set_id", F.when(F.col("set_id").isin([r[0] for r in shared]), F.col("check")).otherwise(F.col("set_id")))


def _prepared(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The written sets, the same ready for use, classes of equal sets, pairs of small blocks, and bundles of large ones."""
    written = materialize(_describe(docs, k), "join-sets")
    sets = _rekeyed(written)
    classes = sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(classes, "join-classes")
    blocks = materialize(_blocks(_first_grams(sets, num, den, _common(sets)), num, den), "join-blocks")
    bundles = materialize(_bundles(_large(blocks)), "join-bundles")
    return written, sets, classes, blocks, bundles


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two rows link when the Jaccard similarity of their sets of ``k``-word
    shingles is at least ``num / den``; ``component_id`` is the smallest doc_id
    that links lead to, itself included. Rows with equal sets are linked. A null
    text and a text without words have an empty set and link with nothing, so
    their component is their own doc_id. A text of fewer than ``k`` words has one
    shingle. Rows that repeat a doc_id are separate documents; a null doc_id
    is never the smallest. No rows give no rows; other columns are ignored,
    whatever their names. Texts are read whole. Shingles are told apart by
    64-bit hashes, sets by 128 bits. For the links themselves see :func:`links`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _linked(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links of ``docs`` (doc_id, text), as pairs of classes and the classes' members.

    The first result has set_id, doc_id, n_shingles and n_links: a row per
    document with the class of its set (null if empty) and the number of other
    classes that the class links with. The second has u, v (classes, u < v) and
    overlap (shingles that both hold). Copies are not expanded into pairs. Rows
    are treated as in :func:`link`. As every link is a row, the result can grow
    with the square of a group of near copies.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of(docs.sparkSession, BATCH):
        return _link_pairs(docs, k, num, den)


def _link_pairs(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    written, sets, classes, blocks, bundles = _prepared(docs, k, num, den)
    pairs = _small(blocks).union(_met(bundles, bundles, num, den)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(_possible(pairs, classes, num, den), "join-pairs")
    found = materialize(_verify(sets, pairs, num, den), "join-links")
    degree = found.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("key"))
    members = rows.join(degree, "key", "left").select(F.col("key").alias("set_id"), "doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    members = materialize(members, "join-members")
    discard(written, classes, blocks, bundles)
    return members, found


def _large(blocks: DataFrame) -> DataFrame:
    return blocks.filter("v IS NULL").select("gram", F.col("u").alias("set_id"), "n", "pos", "rank")


def _small(blocks: DataFrame) -> DataFrame:
    return blocks.filter("v IS NOT NULL").select("u", "v")


def _linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    with batches_of(docs.sparkSession, BATCH):
        return _link_rows(docs, k, num, den)


def _link_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """n, label, component and whatever names a row (doc_id; text_id if ``docs`` have one) for every row; rows of one component, and no others, share a ``label``."""
    written, sets, classes, blocks, bundles = _prepared(docs, k, num, den)
    large = bundles
    pairs = _small(blocks).union(_leaders(large.withColumn("label", F.col("set_id")), 0, 1, num, den)).distinct()
    links = docs.sparkSession.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    labels, low, high = links.select(F.col("u").alias("node"), F.col("v").alias("label")), 0, 1
    while True:
        pairs = materialize(_possible(pairs, classes, num, den), "join-pairs")
        if pairs.limit(1).count():
            links = links.union(materialize(_verify(sets, pairs, num, den).select("u", "v"), "join-links"))
            # The smallest leader that a set links with: cheap, and enough to pass over most of a block.
            near = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
            jump = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = materialize(near.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "join-labels")
        low, high = high, high + 8 ** (1 + _log8(high))
        named = large.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        ends = named.filter(F.col("rank") >= low).groupBy("lead", "part").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
        alive = materialize(named.join(ends.select("lead", "part"), ["lead", "part"], "left_semi"), "join-large")
        if alive.limit(1).count() == 0:
            break
        pairs = _leaders(alive, low, high, num, den).distinct()
        large = alive.drop("label")
    labels = components(links)
    known = classes.select("set_id", "first").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = known.groupBy("label").agg(F.min("first").alias("component"))
    by_set = known.join(smallest, "label").select(F.col("set_id").alias("key"), "label", "component")
    named = [c for c in ("doc_id", "text_id") if c in sets.columns]
    out = sets.select(*named, "n", F.when(F.col("n") > 0, F.col("set_id")).alias("key")).join(by_set, "key", "left").drop("key")
    out = materialize(out, "join-rows")
    discard(written, classes, blocks, bundles)
    return out


def _log8(x: int) -> int:
    return (x.bit_length() - 1) // 3


def _bundles(large: DataFrame) -> DataFrame:
    """Large blocks by their first member ``lead``, BUNDLED of them a ``part``: a row per set with its ``blocks`` as bits, its place ``pos`` in each, and its rank.

    A lead's places number its blocks, so their bits follow the global order.
    """
    number = F.row_number().over(Window.partitionBy("lead").orderBy("at")) - 1
    first = large.filter("rank = 0").select("gram", F.col("set_id").alias("lead"), F.col("pos").alias("at")).withColumn("number", number)
    first = first.select("gram", "lead", F.floor(F.col("number") / BUNDLED).cast("int").alias("part"), (F.col("number") % BUNDLED).cast("int").alias("bit"))
    rows = large.join(first, "gram").groupBy("lead", "part", "set_id").agg(
        F.first("n").alias("n"), F.expr("bit_or(shiftleft(1L, bit))").alias("blocks"), F.array_sort(F.collect_list(F.struct("bit", "pos")))["pos"].alias("pos"),
        F.sum("pos").alias("places"),
    )
    rank = F.row_number().over(Window.partitionBy("lead", "part").orderBy(F.bit_count("blocks").desc(), "places", "set_id")) - 1
    return rows.select("lead", "part", "set_id", "n", "blocks", "pos", rank.cast("long").alias("rank"))


def _met(lead: DataFrame, rest: DataFrame, num: int, den: int, also: Column | None = None) -> DataFrame:
    """Pairs (u of ``lead``, v of ``rest``, of a later rank) that share a block of a bundle whose places in both orders allow a link.

    Places in the first shared block allow most; in the others they are no smaller.
    """
    keys = ["lead", "part"]
    lead = lead.select(*keys, *[F.col(c).alias("u" + c[0]) for c in lead.columns if c not in keys])
    rest = rest.select(*keys, *[F.col(c).alias("v" + c[0]) for c in rest.columns if c not in keys])
    shared = F.col("ub").bitwiseAND(F.col("vb"))
    below = shared.bitwiseAND(-shared) - 1  # the bits before the first shared one
    left = lambda x: F.col(f"{x}n") - F.get(F.col(f"{x}p"), F.bit_count(F.col(f"{x}b").bitwiseAND(below)))
    near = F.least(left("u"), left("v")).cast("long") * (num + den) >= (F.col("un") + F.col("vn")).cast("long") * num
    met = rest.join(lead, keys).filter((F.col("vr") > F.col("ur")) & (shared != 0) & near)
    return (met if also is None else met.filter(also)).select(F.col("us").alias("u"), F.col("vs").alias("v"))


def _leaders(large: DataFrame, low: int, high: int, num: int, den: int) -> DataFrame:
    """Pairs of the members with ranks ``low`` to ``high`` and all later members of their bundles, where bounds allow a link and labels differ."""
    return _met(large.filter((F.col("rank") >= low) & (F.col("rank") < high)), large, num, den, F.col("ul") != F.col("vl"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text and anything else), and all rows without a shingle.

    The row with the smallest doc_id stays, null after all others. Each row is
    judged by its own text, whoever shares its doc_id: rows are told apart by
    doc_id and a 64-bit hash of the text, and under one doc_id the smallest
    hash stays. Of rows that are equal in both one stays. Rows to drop
    are broadcast if they are few and joined by a shuffle if not.
    """
    own = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("text_id"))
    linked = materialize(_linked(keyed, k, num, den).filter("n > 0").groupBy("label", "doc_id", "text_id").agg(F.count("*").alias("copies")), "join-linked")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    judged = linked.withColumn("place", place).join(linked.groupBy("label").agg(F.min(place).alias("first")), "label")
    judged = judged.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "copies", (F.col("place") == F.col("first")).alias("stays"))
    judged = materialize(judged.filter("NOT stays OR copies > 1"), "join-judged")
    few = lambda df: F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (own == F.col("_text"))
    kept = docs.join(few(judged.filter("NOT stays").select("_doc", "_text")), same, "left_anti")
    repeated = judged.filter("stays").select("_doc", "_text")
    if repeated.limit(1).count() == 0:
        return kept
    repeated = few(repeated)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
