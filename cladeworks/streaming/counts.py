"""Running sums of long counts: counts are a commutative monoid, so files of them can be added as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.counting import COUNTS


def running_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame (cpt, kind, i, j, value) of the sums of all JSON rows in a folder; write it in complete or update mode. Its state
    has one row for each cell of a model, however many files come."""
    rows = spark.readStream.schema(COUNTS).json(folder)
    return rows.groupBy("cpt", "kind", "i", "j").agg(F.sum("value").alias("value"))
