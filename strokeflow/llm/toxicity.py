"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself), each hashed to a
bucket that owns a small vector; a text is the mean of its words. The
embeddings and the softmax are trained together on a bounded sample of
labelled texts. The trained model is linear in the buckets, so scoring folds
both layers into one number per bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import table

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: Training texts whose bags are held at a time.
SLICE = 128
#: Texts of a batch that are scored at a time.
SCORED = 512
DIM = 8


def subwords(words: ta.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, word number and weight of every subword; a word's weights add up to 1."""
    found = [(words.whole(), np.arange(words.n))] + [words.ngrams(n) for n in GRAMS]
    h = np.concatenate([x for x, _ in found])
    word = np.concatenate([x for _, x in found])
    weight = 1 / np.bincount(word, minlength=words.n)[word]
    return (h % ta.U(BUCKETS)).astype(np.int64), word, weight


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their weights, which add up to 1 (none for a text without words)."""
    out: list[list] = [[] for _ in texts]
    count = np.zeros(len(texts))
    for words in ta.chunks(texts, ta.not_space()):
        if not words.n:
            continue
        bucket, word, weight = subwords(words)
        np.add.at(count, words.doc, 1)
        key = words.doc[word] * BUCKETS + bucket
        uniq, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weight)
        doc = uniq // BUCKETS
        for d in np.unique(doc):
            m = slice(*np.searchsorted(doc, [d, d + 1]))
            out[d].append(((uniq[m] % BUCKETS).astype(np.int32), total[m].astype(np.float32)))
    return [
        (np.concatenate([b for b, _ in o]), np.concatenate([w for _, w in o]) / n) if o else (np.zeros(0, np.int32), np.zeros(0, np.float32))
        for o, n in zip(out, count)
    ]


def _apart(held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket, from the texts of each class that hold it: a two-sample z, and the absolute log odds ratio."""
    share = (held.sum(0) + 1) / (n.sum() + 2)
    z = (held[1] / n[1] - held[0] / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
    odds = np.abs(np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1)))
    return np.abs(z), odds


def _fit(x: np.ndarray, labels: np.ndarray, odds: np.ndarray, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Adam over embeddings and softmax together; the folded weight of each column of ``x`` and the bias.

    Columns are brought to a standard deviation of their absolute log odds
    ratio, so that the steps favour telling buckets.
    """
    scale = (odds / np.maximum(x.std(0), 1e-7)).astype(np.float32)
    mean = x.mean(0)
    x = (x - mean) * scale
    rng = np.random.default_rng(seed)
    y = np.eye(2, dtype=np.float32)[labels]
    params = [
        rng.normal(0, 1 / np.sqrt(max(1, x.shape[1])), (x.shape[1], DIM)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2)).astype(np.float32),
        np.log(y.mean(0)),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        hidden = x @ params[0]
        z = hidden @ params[1] + params[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) / len(y)
        grads = [x.T @ (g @ params[1].T) + decay * params[0], hidden.T @ g + decay * params[1], g.sum(0)]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            params[i] = params[i] - rate / (1 + step / 50) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    fold = (params[0] @ (params[1][:, 1] - params[1][:, 0])) * scale
    return fold, float(params[2][1] - params[2][0] - mean @ fold)


def _least_z(x: np.ndarray, labels: np.ndarray, options: tuple[float, ...], folds: int, false_cost: float, **fit) -> float:
    """The one of ``options`` with the least error over ``folds`` parts of the sample, each judged by a model of the others; the largest of equals.

    The error is the share of texts of class 1 that are missed, plus
    ``false_cost`` times the share of class 0 that is taken for class 1: if
    texts weighed the same, no model at all would do best where one class is rare.
    """
    if len(options) == 1:
        return options[0]
    part = np.empty(len(labels), int)
    for c in (0, 1):
        of = np.flatnonzero(labels == c)
        part[of] = np.arange(len(of)) % folds
    loss = np.zeros(len(options))
    for f in range(folds):
        own, rest = part == f, part != f
        n = np.bincount(labels[rest], minlength=2)
        if n.min() == 0:
            continue
        z, odds = _apart(np.stack([(x[rest & (labels == c)] > 0).sum(0) for c in (0, 1)]), n)
        for i, least in enumerate(options):
            at = np.flatnonzero(z >= least)
            weight, bias = _fit(x[np.ix_(rest, at)], labels[rest], odds[at], **fit)
            wrong = (x[np.ix_(own, at)] @ weight + bias >= 0) != (labels[own] == 1)
            loss[i] += (wrong * np.where(labels[own] == 1, 1.0, false_cost) / np.bincount(labels, minlength=2)[labels[own]]).sum()
    return max(o for o, l in zip(options, loss) if l <= loss.min() * (1 + 1e-9))


def train(
    texts: list[str], labels: np.ndarray, steps: int = 200, rate: float = 0.01, decay: float = 1e-2, seed: int = 7,
    known: int = 4096, least_z: tuple[float, ...] = (5.0, 4.0, 3.0, 2.0), folds: int = 5, false_cost: float = 2.0,
) -> tuple[np.ndarray, float]:
    """The folded weight of each bucket and the bias, from labelled texts (labels 0 and 1).

    Buckets whose presence tells the classes apart by a two-sample z own a
    vector, the ``known`` most telling ones at most, so the design matrix is at
    most sample rows times ``known`` numbers. How large z has to be is the one
    of ``least_z`` that cross-validation in ``folds`` parts prefers: many labels
    can afford a strict choice, few labels need a lenient one. A harmless text
    taken for toxic counts ``false_cost`` times as much as a toxic one missed.
    """
    if len(texts) == 0 or labels.min() == labels.max():
        prior = float(labels.mean()) if len(labels) else 0.0
        return np.zeros(BUCKETS), 30.0 * (2 * prior - 1) if len(labels) else -30.0
    # Bags are made twice, a slice of texts at a time, so that only the design matrix is held whole.
    slices = [slice(i, i + SLICE) for i in range(0, len(texts), SLICE)]
    n = np.bincount(labels, minlength=2)
    held = np.zeros((2, BUCKETS), np.int64)
    for part in slices:
        for (idx, _), y in zip(bags(texts[part]), labels[part]):
            held[y, idx] += 1
    z, odds = _apart(held, n)
    telling = np.argsort(-z, kind="stable")[:known]
    telling = telling[z[telling] >= min(least_z)]
    place = np.full(BUCKETS, -1)
    place[telling] = np.arange(len(telling))
    x = np.zeros((len(texts), len(telling)), np.float32)
    for part in slices:
        for row, (idx, val) in zip(range(part.start, part.stop), bags(texts[part])):
            at = place[idx]
            x[row, at[at >= 0]] = val[at >= 0]
    least = _least_z(x, labels, least_z, folds, false_cost, steps=steps // 2, rate=rate, decay=decay, seed=seed)
    some = z[telling] >= least
    weight = np.zeros(BUCKETS)
    weight[telling[some]], bias = _fit(x[:, some], labels, odds[telling[some]], steps, rate, decay, seed)
    return weight, bias


def score_texts(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for words in ta.chunks(texts, ta.not_space()):
        if words.n:
            bucket, word, share = subwords(words)
            of = np.bincount(word, weight[bucket] * share, words.n)
            total += np.bincount(words.doc, of, len(texts))
            count += np.bincount(words.doc, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def score_batch(texts: pa.Array, weight: np.ndarray, bias: float) -> pa.Array:
    """The score of each of ``texts``, of which SCORED at a time are Python strings."""
    parts = [score_texts(texts.slice(i, SCORED).to_pylist(), weight, bias) for i in range(0, len(texts), SCORED)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """About ``max_rows`` labelled texts (text, toxic) of at most ``max_bytes``, chosen by hashes."""
    share = lambda n: int(min(1.0, max_rows / max(1, n)) * (1 << 62))
    below = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 62))
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = labels.filter(below("doc_id", F.lit(1)) <= share(labels.count()))
    rows = (
        docs.filter(F.octet_length("text") <= max_bytes).select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most about max_rows rows of two numbers
        .select("doc_id", "text", "toxic")
    )
    # A labelled doc_id may have any number of texts.
    return rows.filter(below("doc_id", "text", F.lit(2)) <= share(rows.count())).select("text", "toxic").distinct()


def _ordered(texts: list[str], toxic: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Whatever order the rows arrive in, training sees one."""
    order = sorted(range(len(texts)), key=lambda i: (hashlib.md5(texts[i].encode()).digest(), toxic[i]))
    return [texts[i] for i in order], toxic[order]


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """About ``max_rows`` labelled texts of at most ``max_bytes``, chosen by hashes; what reaches the driver is bounded by both.

    Equal texts with the same label are one example, whichever rows hold them.
    """
    rows = _sample(docs, labels, max_rows, max_bytes).toPandas()
    return _ordered(rows.text.tolist(), rows.toxic.to_numpy(np.int64))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, **training) -> tuple[np.ndarray, float]:
    """:func:`train` on the :func:`training_sample`, in one task: texts and design matrix stay away from the driver."""
    schema = pa.schema([("weight", pa.binary()), ("bias", pa.float64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], [np.zeros(0, np.int64)]
        for batch in batches:
            texts += batch["text"].to_pylist()
            toxic.append(batch["toxic"].to_numpy().astype(np.int64))
        weight, bias = train(*_ordered(texts, np.concatenate(toxic)), **training)
        yield pa.RecordBatch.from_arrays([pa.array([weight.astype(np.float64).tobytes()], pa.binary()), pa.array([bias], pa.float64())], schema=schema)

    found = _sample(docs, labels, max_rows, max_bytes).coalesce(1).mapInArrow(fit, "weight binary, bias double").collect()
    # Without rows there may be no task either.
    return (np.frombuffer(found[0].weight, np.float64), found[0].bias) if found else train([], np.zeros(0, np.int64), **training)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_bytes: int = 1 << 15, column: str = "score", **training) -> DataFrame:
    """Adds ``column`` (0 to 1) to ``docs`` (text and anything else), trained on ``labels`` (doc_id, toxic).

    The training rows are a documented bounded sample: about ``max_rows``
    labelled texts of at most ``max_bytes`` each; ``training`` are the parameters
    of :func:`train`. Scores use the text alone, read whole. Null and
    empty texts get the score of no evidence, the model's prior; without
    labels of both classes the score is a constant near that class. Rows with
    a null label teach nothing; equal texts with the same label teach once.
    Equal texts have equal scores. A column of the name ``column`` is replaced,
    all others stay. No rows give no rows.
    """
    weight, bias = trained(docs, labels, max_rows, max_bytes, **training)
    held = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias))  # BUCKETS numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight, bias = held.value
        for texts in batches:
            yield score_batch(texts, weight, bias)

    return docs.withColumn(column, score(F.col("text").cast("string")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    learn = table(spark, sf_dir, "labels").filter(remainder != 0)
    return score_toxicity(docs, learn).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
