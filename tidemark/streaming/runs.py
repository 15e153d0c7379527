"""Running a stream to completion or on a schedule, with restartable positions and atomic results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """File source with a declared schema; new files below the path are picked up in later runs."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC, so the moment does not change."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _finish(writer: DataStreamWriter, every: str | None):
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(df: DataFrame, out: str, checkpoint: str, every: str | None = None):
    """Append finished rows to a Parquet table; the checkpoint holds the position, so a restart neither
    repeats nor loses input. Without ``every`` it works off what is there and stops."""
    return _finish(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"), every)


def replace_table(df: DataFrame, out: str, checkpoint: str, mode: str = "complete", every: str | None = None):
    """Publish each result as a new version folder; readers of :func:`read_latest` switch when it is complete."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return _finish(df.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode(mode), every)


def publish_cycle(df: DataFrame, out: str) -> int:
    """Publish a table made from what is there now as the next version folder; returns its number.

    A cycle that starts from the present files forgets replaced and deleted ones, which a stream over the
    same folder, adding up what arrives, does not. Readers of :func:`read_latest` switch when it is complete.
    """
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    number = 1 + max((int(n[len("version="):]) for n in names if n.startswith("version=")), default=-1)
    df.write.mode("overwrite").parquet(f"{out}/version={number}")
    return number


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of a replaced table (version is a partition column, so others are not read)."""
    df = spark.read.parquet(out)
    newest = df.agg(F.max("version").alias("v"))
    return df.where(F.col("version") == newest.scalar()).drop("version")


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """Hand every batch and its id to ``work``; a batch repeated after a failure keeps its id."""
    return _finish(df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode(mode), every)
