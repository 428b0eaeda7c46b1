"""All query modules of the core, in the order of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmill.plans import checks, migration, quality, training, trees

PARTS = [training, quality, migration, trees, checks]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue counters of the quality gate over the current catalog."""
    return quality.qa_counters(spark, sf_dir)
