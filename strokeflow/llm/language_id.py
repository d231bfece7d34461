"""Language ID: known words by per-language log frequency, unseen words by progressively shorter character n-grams.

A word is a run of letters, in lower case. The model holds the commonest words
and the commonest character n-grams of each length, per language, counted over
a bounded sample of labelled texts. A word that the model knows scores its log
frequency in each language. Any other word falls back to the longest n-grams
of it that are known, and scores the mean of theirs. A text takes the language
of the largest sum over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import materialize, table

#: Lengths of n-grams, in the order of the fallback.
GRAMS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"


def counted(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of words (0) and of each length of n-gram."""
    parts: dict[int, list[np.ndarray]] = {n: [] for n in (0, *GRAMS)}
    for words in ta.chunks(texts, ta.letters()):
        if words.n:
            parts[0].append(words.whole())
            for n in GRAMS:
                parts[n].append(words.ngrams(n)[0])
    return {n: np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, ta.U), np.zeros(0, np.int64)) for n, x in parts.items()}


def count_sample(docs: DataFrame, lang: str, max_rows: int, max_bytes: int) -> DataFrame:
    """lang, n, hash, count over about ``max_rows`` texts per language of at most ``max_bytes`` each, chosen by a hash of doc_id and text.

    Of a language whose texts are all longer, the shortest ones are eligible.
    """
    size = F.octet_length("text")
    labelled = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang).alias("_lang"))
    sizes = labelled.groupBy("_lang").agg(F.min(size).alias("_shortest"), F.count_if(size <= max_bytes).alias("_short"))
    sizes = materialize(sizes.select("_lang", F.greatest("_shortest", F.lit(max_bytes)).alias("_most"), F.least(F.lit(1.0), max_rows / F.greatest("_short", F.lit(1))).alias("_share")), "lang-sizes")
    few = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    share = F.when(F.col("_most") > max_bytes, 1.0).otherwise(F.col("_share"))
    chosen = (
        labelled.join(few, "_lang").filter(size <= F.col("_most"))
        .filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(1 << 52)) < share * (1 << 52))
        .select("_lang", "text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, texts in pdf.groupby("_lang").text:
                for n, (h, c) in counted(list(texts)).items():
                    yield pd.DataFrame({"lang": name, "n": n, "hash": h.view(np.int64), "count": c})

    return (
        chosen.mapInPandas(count, "lang string, n int, hash long, count long").groupBy("lang", "n", "hash").agg(F.sum("count").alias("count"))
    )


class Model:
    """Sorted hashes per kind, with a row of log frequencies per hash and language."""

    def __init__(self, counts: pd.DataFrame, totals: pd.DataFrame):
        self.langs = sorted(totals.lang.unique())
        code = {x: i for i, x in enumerate(self.langs)}
        sums = {(n, x): t for x, n, t in zip(totals.lang, totals.n, totals.total)}
        self.keys, self.logs = {}, {}
        for n in (0, *GRAMS):
            part = counts[counts.n == n]
            key, at = np.unique(part.hash.to_numpy(np.int64).view(ta.U), return_inverse=True)
            table = np.zeros((len(key), len(self.langs)))
            np.add.at(table, (at, part.lang.map(code).to_numpy(np.int64)), part["count"].to_numpy(float))
            total = np.array([sums.get((n, x), 0) for x in self.langs], float)
            self.keys[n] = key
            self.logs[n] = np.log((table + 0.1) / (total + 0.1 * (len(key) + 1))).astype(np.float32)

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        key = self.keys[n]
        if not len(key):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        return np.where(key[at] == h, at, -1)

    def word_scores(self, words: ta.Words) -> np.ndarray:
        """A row per word of log frequencies per language; zeros where nothing is known."""
        uniq, first, inverse = np.unique(words.whole(), return_index=True, return_inverse=True)
        out = np.zeros((len(uniq), len(self.langs)))
        at = self._find(0, uniq)
        out[at >= 0] = self.logs[0][at[at >= 0]]
        open_ = at < 0
        number = np.full(words.n, -1)
        number[first] = np.arange(len(uniq))
        for n in GRAMS:
            if not open_.any():
                break
            mask = (number >= 0) & open_[number]
            h, word = words.ngrams(n, mask)
            at = self._find(n, h)
            known = at >= 0
            of = number[word[known]]
            got = np.bincount(of, minlength=len(uniq))
            for k in range(len(self.langs)):
                out[:, k] += np.where(got > 0, np.bincount(of, self.logs[n][at[known], k], len(uniq)) / np.maximum(got, 1), 0)
            open_ &= got == 0
        return out[inverse]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums = np.zeros((len(texts), max(1, len(self.langs))))
        count = np.zeros(len(texts))
        for words in ta.chunks(texts, ta.letters()):
            if words.n:
                count += np.bincount(words.doc, minlength=len(texts))
                of = self.word_scores(words) if self.langs else np.zeros((words.n, 1))
                for k in range(len(self.langs)):
                    sums[:, k] += np.bincount(words.doc, of[:, k], len(texts))
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        some = (count > 0) & bool(self.langs)
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, p[np.arange(len(best)), best], 0.0)


def learn(
    docs: DataFrame, lang: str = "lang", max_rows: int = 1500, max_bytes: int = 1 << 15, max_words: int = 20_000, max_grams: int = 10_000, max_cells: int = 1 << 26
) -> Model:
    """The model of ``docs`` (doc_id, text, lang), from a bounded sample of labelled rows.

    About ``max_rows`` texts of each language are counted, of at most
    ``max_bytes`` (where a language has none so short, its shortest ones).
    The model knows the ``max_words`` commonest words and the ``max_grams``
    commonest n-grams of each length per language; all others fall back. It is a
    table of hashes by languages, and where those caps would make it larger than
    ``max_cells`` numbers, they shrink alike for all languages: every language
    is learned, however many there are. A null language teaches nothing.
    """
    counts = materialize(count_sample(docs, lang, max_rows, max_bytes), "lang-counts")
    n_langs = max(1, counts.select("lang").distinct().count())
    shrink = min(1.0, max_cells / (n_langs * n_langs * (max_words + len(GRAMS) * max_grams)))
    words, grams = (max(1, int(cap * shrink)) for cap in (max_words, max_grams))
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total")).toPandas()  # a row per language and length
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "hash"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("n") == 0, words).otherwise(grams))
    return Model(top.select("lang", "n", "hash", "count").toPandas(), totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the winner's share of the softmax, 0 to 1) to ``docs`` (text and anything else).

    Only the text counts. A text that is null or without a letter is ``und``
    with score 0, and so is every text if the model learned from no row. Ties
    go to the first language by code point. Texts are read whole; equal texts
    get equal results. Columns of the names ``lang_pred`` and ``score`` are
    replaced, all others stay, whatever their names. No rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams per language

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = held.value.predict(list(texts))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    got = docs.select(F.struct(*rest).alias("rest"), predict(F.col("text").cast("string")).alias("found"))
    return got.select("rest.*", "found.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
