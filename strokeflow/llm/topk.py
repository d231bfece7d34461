"""Exact top-k search: BM25 over an inverted index, with scores known beforehand to be reached, and an exact merge.

Queries are taken in blocks of bounded size. For a block, one pass over the
documents counts how many hold each query term. A second looks at a part of the
documents only: the k-th best score there is one that a query's k-th best of
all documents cannot fall below. The third takes all documents, shard by shard.
A shard has an inverted index whose longest lists are kept as a matrix. A
product with it and the other lists give a batch of queries' scores of all the
shard's documents in single precision; documents that may reach the known score
are scored again in double precision. Scores use global statistics, so the best
of the shards' lists are the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles
from .storage import materialize, table
from .textarrays import U

K1, B = 1.2, 0.75
#: Documents and postings of a shard at most, decimals of a score.
SHARD_DOCS = 16_384
SHARD_POSTINGS = 4_000_000
DECIMALS = 6
#: Lists of a shard that are kept as a matrix, queries that are multiplied with it at a time, postings that are summed at a time.
DENSE = 1024
BATCH = 256
SUMMED = 1 << 16
#: What scores in single precision may be off by, as a share of them: all impacts are positive, so errors do not cancel a score out.
SINGLE = 2e-4
#: Documents that are looked at first, and their share of all at most.
FIRST_DOCS = 131_072
FIRST_SHARE = 1 / 8
#: Distinct terms of a block of queries, all queries together.
QUERY_TERMS = 4_000_000


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... (``size`` of them) of all spans, end to end."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class Index:
    """The inverted index of one shard. Terms are numbers in a block of queries' vocabulary.

    Postings are kept by document, with impacts in double precision, and by
    term, in single precision; those of the DENSE terms with the longest lists
    as a matrix.
    """

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float):
        if (doc[1:] < doc[:-1]).any():
            by_doc = np.argsort(doc, kind="stable")
            term, doc, tf = term[by_doc], doc[by_doc], tf[by_doc]
        self.ids, self.term = ids, term
        norm = K1 * (1 - B + B * length / mean)
        self.exact = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.first = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.weight = np.zeros(len(idf))
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order].astype(np.int32), self.exact[order].astype(np.float32)
        self.border = np.append(0, np.cumsum(np.bincount(term, minlength=len(idf))))
        df = np.diff(self.border)
        dense = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        self.column = np.full(len(idf), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), len(ids)), np.float32)
        i = _gathered(self.border[dense], df[dense])
        self.matrix[np.repeat(np.arange(len(dense)), df[dense]), self.doc[i]] = self.impact[i]

    def _scores(self, of: np.ndarray, terms: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """Scores of all documents, in single precision, for ``queries`` queries: ``of`` is the query of each term and weight, in order."""
        n, at = len(self.ids), self.column[terms]
        m = at >= 0
        weights = np.zeros((queries, len(self.matrix)), np.float32)
        weights[of[m], at[m]] = weight[m]
        out = weights @ self.matrix
        of, terms, weight = of[~m], terms[~m], weight[~m].astype(np.float32)
        begin, size = self.border[terms], self.border[terms + 1] - self.border[terms]
        # As many whole queries at a time as have about SUMMED postings.
        start = np.searchsorted(of, np.arange(queries + 1))
        upto = np.append(0, np.cumsum(size))[start]
        q = 0
        while q < queries:
            end = max(q + 1, int(np.searchsorted(upto, upto[q] + SUMMED, "right")) - 1)
            i, j = start[q], start[end]
            p = _gathered(begin[i:j], size[i:j])
            key = np.repeat((of[i:j] - q) * n, size[i:j]) + self.doc[p]
            part = np.bincount(key, np.repeat(weight[i:j], size[i:j]) * self.impact[p], (end - q) * n)
            out[q:end] += part.reshape(end - q, n)
            q = end
        return out

    def batch(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the best ``k`` documents of each query (terms, weights), by rounded score and then id; documents without a term never show, and below ``least`` may be missing."""
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        terms, weight = (np.concatenate([q[i] for q in queries]) for i in range(2))
        low = np.zeros(len(queries)) if least is None else least * (1 - SINGLE) - 2 * 10.0**-DECIMALS
        scores = self._scores(of, terms, weight, len(queries))
        q, places = np.nonzero((scores > 0) & (scores >= low[:, None].astype(np.float32)))
        scores, border = scores[q, places], np.searchsorted(q, np.arange(len(queries) + 1))
        for (terms, weight), i, j in zip(queries, border[:-1], border[1:]):
            some = places[i:j]
            if len(some) > k:
                some = some[scores[i:j] >= np.partition(scores[i:j], -k)[-k] * (1 - 2 * SINGLE) - 2 * 10.0**-DECIMALS]
            exact = self._rescored(terms, weight, some)
            best = np.lexsort((self.ids[some], -exact))[:k]
            yield some[best], exact[best]

    def _rescored(self, terms: np.ndarray, weight: np.ndarray, places: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(0)
        self.weight[terms] = weight
        size = self.first[places + 1] - self.first[places]
        p = _gathered(self.first[places], size)
        total = np.bincount(np.repeat(np.arange(len(places)), size), self.weight[self.term[p]] * self.exact[p], len(places))
        self.weight[terms] = 0
        return np.round(total, DECIMALS)


def _vectors(rows: DataFrame) -> DataFrame:
    """(query_id, terms, counts) of texts, as bytes of 64-bit hashes and 32-bit counts."""
    schema = pa.schema([("query_id", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, of, tf in shingles.bags(batch["text"]):
                border = np.searchsorted(of, np.arange(row, end + 1))
                spans = list(zip(border[:-1], border[1:]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][row:end], pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([tf[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary())],
                    schema=schema,
                )

    return rows.mapInArrow(vectors, "query_id long, terms binary, counts binary")


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Documents per term of the vocabulary, all documents, their mean length in words."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, docs, words = held.value, 0, 0
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            docs += batch.num_rows
            for _, _, h, _, tf in shingles.bags(batch["text"]):
                words += int(tf.sum())
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                if len(vocabulary):
                    df += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]).astype(np.int32)), pa.array(np.append(df[some], [docs, words]))], schema=schema)

    sums = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row per term
    of = dict(zip(sums.term[sums.term < 0], sums.n[sums.term < 0]))
    df = np.zeros(len(vocabulary), np.int64)
    known = sums[sums.term >= 0]
    df[known.term] = known.n
    n = int(of.get(-1, 0))
    return df, n, max(int(of.get(-2, 0)), 1) / max(n, 1)


def _search_block(docs: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """(query, query_id, doc_id, score): each shard's best ``k`` of a block of queries, without some that are not among the best of all."""
    hashes = [np.frombuffer(x, U) for x in queries.terms]
    counts = [np.frombuffer(x, np.int32) for x in queries.counts]
    border = np.append(0, np.cumsum([len(x) for x in hashes])).astype(np.int64)
    vocabulary, number = np.unique(np.concatenate([*hashes, np.zeros(0, U)]), return_inverse=True)
    df, n, mean = _frequencies(docs, vocabulary)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    ids = queries.query_id.to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, number.astype(np.int32), np.concatenate([*counts, np.zeros(0, np.int32)]), border, ids, idf))
    docs = docs.filter("doc_id IS NOT NULL")
    # Documents for a first look, by hash: whatever they are, their k-th best score is a bound.
    share = min(FIRST_SHARE, FIRST_DOCS / max(n, 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).repartition(int(share * n * 2 // SHARD_DOCS) + 1)
    known = _ranked(_search_shards(some, held, mean, k, None), k).filter(F.col("rank") == k).select("query", "score").toPandas()  # a row per query
    least = np.zeros(len(ids))
    least[known["query"]] = known["score"]
    return _search_shards(docs, held, mean, k, least)


def _search_shards(docs: DataFrame, held: Broadcast, mean: float, k: int, least: np.ndarray | None) -> DataFrame:
    """(query, query_id, doc_id, score): each shard's best ``k``, or those of them that reach ``least``."""
    bound = docs.sparkSession.sparkContext.broadcast(least)
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number, qtf, border, ids, idf = held.value
        least = bound.value
        parts: list[tuple] = []
        docs = postings = 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal docs, postings
            doc_ids, term, doc, tf, length = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            docs = postings = 0
            index = Index(doc_ids, term, doc, tf, length, idf, mean)
            out: list[tuple] = []
            for first in range(0, len(ids), BATCH):
                some = range(first, min(first + BATCH, len(ids)))
                vectors = [(number[border[q] : border[q + 1]], qtf[border[q] : border[q + 1]]) for q in some]
                for q, (places, scores) in zip(some, index.batch(vectors, k, None if least is None else least[some.start : some.stop])):
                    if len(places):
                        out.append((np.full(len(places), q), np.full(len(places), ids[q]), index.ids[places], scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

        for batch in batches:
            doc_ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for row, end, h, of, tf in shingles.bags(batch["text"]):
                length = np.bincount(of - row, tf, end - row)
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                m = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                parts.append((doc_ids[row:end], at[m].astype(np.int32), of[m] - row + docs, tf[m], length))
                docs += end - row
                postings += int(m.sum())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from shard()
        if parts:
            yield from shard()

    return docs.mapInArrow(search, "query long, query_id long, doc_id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", best).filter(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score: the best ``k`` of ``docs`` (doc_id, text) for every row of ``queries`` (doc_id, text).

    Words are those of the shingles (A-Z count as a-z); a query's repeated word
    counts as often as it is there. Scores are rounded to ``DECIMALS`` places
    and ties go to the smaller doc_id. A query that is itself among the
    documents finds itself. Documents that share no word with a query are no
    hits, so null and empty queries have no rows, and neither has an empty
    table. Repeated rows of ``docs`` are hits of their own, and of ``queries``
    queries of their own. Documents and queries with a null id count in the
    statistics only. Other columns are ignored.
    """
    cast = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    docs = docs.select(*cast)
    vectors = materialize(_vectors(queries.select(*cast).filter("doc_id IS NOT NULL")), "topk-queries")
    total = vectors.agg(F.sum(F.octet_length("terms") / 8)).first()[0] or 0
    blocks = int(total // QUERY_TERMS) + 1
    found: list[DataFrame] = []
    for b in range(blocks):
        # Dealt by hash, a block holds about QUERY_TERMS terms: that bounds what is collected and broadcast.
        block = vectors.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        hits = _search_block(docs, block.sort_values(["query_id", "terms"], ignore_index=True), k)
        found.append(materialize(_ranked(hits, k).select("query_id", "rank", "doc_id", "score"), "topk-hits"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_top_k(docs, docs.filter("doc_id % 100 = 0"), 10)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents
), p AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL
), l AS (SELECT doc_id, sum(tf) AS len FROM p GROUP BY ALL
), c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS mean
), i AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY t, n
), s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.tf * idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM p q JOIN p ON q.t = p.t AND q.doc_id % 100 = 0 JOIN i ON i.t = p.t JOIN l ON l.doc_id = p.doc_id, c GROUP BY ALL
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
