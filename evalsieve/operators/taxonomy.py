"""The failure patterns as a table of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import values


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(values.PATTERNS, "pattern_id string, category string, name string")
