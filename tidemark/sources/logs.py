"""Log text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """One row per line in ``value``; ``with_path`` adds the file path for path labels."""
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("path")) if with_path else df
