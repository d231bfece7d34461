"""Queries over feature tables and models (K, F06 features): fitted and scored inside Spark."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from . import bindings as B

FEATURES = ["x", "y", "speed_before", "speed_after"]


def features(spark, sf) -> DataFrame:
    h = B.hits(spark, sf).select("event_id", *FEATURES, (F.col("event_type") == "wall").cast("double").alias("label"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(h)


#: Rows that models do not learn from.
HELD_OUT = "event_id % 4 = 0"


def scored(model, rows: DataFrame) -> DataFrame:
    """Every row's score, with whether the model has not seen it."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("event_id", F.round(vector_to_array("probability")[1], 6).alias("probability"), F.col("prediction").cast("int").alias("predicted"), F.expr(HELD_OUT).alias("held_out"))


@register("k01_boosted_trees")
def k01(spark, sf):
    rows = features(spark, sf)
    return scored(GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(rows.filter(f"NOT {HELD_OUT}")), rows)


@register("k02_perceptron")
def k02(spark, sf):
    rows = features(spark, sf)
    return scored(MultilayerPerceptronClassifier(layers=[len(FEATURES), 6, 2], maxIter=20, seed=7).fit(rows.filter(f"NOT {HELD_OUT}")), rows)
