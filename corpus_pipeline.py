"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeflow.llm import mixing, ngram_join, packing, quality, toxicity
from strokeflow.llm.storage import materialize, table


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer if a column has it."""
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    score = _free("toxicity", docs.columns)
    return toxicity.score_toxicity(docs, labels, column=score).filter(F.col(score) < 0.5).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; columns named like a statistic come through unchanged."""
    aside = {c: _free(f"given_{c}", docs.columns) for c in docs.columns if c in quality.COLUMNS}
    kept = quality.rate(docs.withColumnsRenamed(aside), with_text=True).filter("kept")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, a similarity of 0.8) the document with the smallest id."""
    return ngram_join.keep_first(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Training, concentration steps, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
