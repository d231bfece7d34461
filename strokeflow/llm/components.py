"""Connected components of an edge table by min labels and pointer jumping.

Nothing is collected: each round is two joins over tables in the shared
folder, and the driver sees one count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, label): label is the smallest node that links lead to. Loops and repeated edges do no harm; no edges give no rows."""
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        # One jump: the label's own label, where it is lower still.
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        stepped = materialize(
            lower.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")),
            "cc-labels",
        )
        labels = stepped.select("node", "label")
        if stepped.filter("moved").limit(1).count() == 0:
            return labels
