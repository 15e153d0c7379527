"""Plain tables: CSV and Parquet in and out, feature files, period partitions, zones."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


class MissingDataError(FileNotFoundError):
    """The input path does not exist."""


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", schema: StructType | str | None = None) -> DataFrame:
    """Header CSV, Parquet, ORC or JSON. Without a schema CSV and JSON types are inferred (an extra pass)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    try:
        return reader.load(path if isinstance(path, str) else list(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise MissingDataError(f"no data at {path}") from error
        raise


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Overwrite ``path``; CSV gets a header row and no index column."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All frames as one set by column name; a column missing on one side is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_feature_parquet(df: DataFrame, path: str, entity: str, ts: str, features: Sequence[str]) -> str:
    """Entity, event time and features only; labels and everything else stay out of the file."""
    return write_table(df.select(entity, ts, *[F.col(c).cast("double").alias(c) for c in features]), path)


def partition_by_period(df: DataFrame, path: str, ts: str = "ts", period: str = "day") -> str:
    """One directory per period. The rebalance hint gathers rows by period and lets adaptive execution
    split a heavy period over tasks and merge light ones, by measured size."""
    part = F.date_trunc(period, ts).cast("date" if period in ("day", "week", "month", "year") else "timestamp_ntz")
    dated = df.withColumn("dt", part)
    return write_table(dated.hint("rebalance", F.col("dt")), path, partition_by=["dt"])


def read_period(spark: SparkSession, path: str, ts: str, start: str, end: str, fmt: str = "parquet", period: str = "day") -> DataFrame:
    """Rows with ``start <= ts < end`` of a table partitioned by the start of each ``period``.

    The partition predicate on ``dt`` is added here, because the optimizer does not derive it from the
    timestamp predicate.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    df = spark.read.format(fmt).load(path)
    dt = F.col("dt").cast("timestamp_ntz")
    pruned = df.where((dt >= F.date_trunc(period, lo).cast("timestamp_ntz")) & (dt <= F.date_trunc(period, hi).cast("timestamp_ntz")))
    return pruned.where((F.col(ts) >= lo) & (F.col(ts) < hi))


ZONES = ("raw", "processed", "features", "artifacts")  # fixed values


def seed_zone(df: DataFrame, root: str, zone: str, version: str, message: str) -> DataFrame:
    """Publish a dataset version to a zone and append a manifest row; returns the manifest row."""
    from tidemark.operators.versions import table_fingerprint

    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}, expected one of {ZONES}")
    path = write_table(df, f"{root}/zone={zone}/version={version}")
    written = df.sparkSession.read.parquet(path)
    row = table_fingerprint(written).select(
        F.lit(zone).alias("zone"), F.lit(version).alias("version"), F.lit(message).alias("message"), "n_rows", "digest"
    )
    row.write.mode("append").parquet(f"{root}/manifest")
    return row


def write_json_row(row: DataFrame, path: str) -> str:
    """A one-row document (evaluation metrics, drift summary) as a single JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def append_snapshot(df: DataFrame, path: str, ts, column: str = "profile_ts") -> str:
    """Append rows under a timestamp-named partition."""
    from tidemark.functions.scalars import snapshot_name

    stamped = df.withColumn(column, snapshot_name(ts if not isinstance(ts, str) else F.lit(ts).cast("timestamp_ntz")))
    stamped.write.mode("append").partitionBy(column).parquet(path)
    return path


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", strict: bool = False) -> bool:
    """Append; unless ``strict`` a failure is logged, reported as False and never raised (best effort)."""
    try:
        df.write.mode("append").format(fmt).save(path)
        return True
    except Exception:
        if strict:
            raise
        logging.getLogger(__name__).warning("could not append to %s", path, exc_info=True)
        return False
