"""Scan report files: one nested JSON document per file."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.scratch import cut
from tidemark.schemas import REPORT

_CORRUPT = "_corrupt"


_SCHEMA = T.StructType([*REPORT.fields, T.StructField(_CORRUPT, T.StringType())])


def _parse(texts: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Good documents and broken ones; blank ones are neither."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = texts.where(F.trim("value") != "").select("value", *more, F.from_json("value", _SCHEMA, options).alias("_r"))
    broken = F.col(f"_r.{_CORRUPT}").isNotNull()
    good = parsed.where(~broken).select(*[f"_r.{n}" for n in REPORT.names], *more)
    return good, parsed.where(broken).select(*more, F.col("value").alias("text"))


def read_reports(spark: SparkSession, path: str, settle_seconds: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Good reports and quarantined ones (file name and broken text), one document per ``*.json`` file.

    Empty files give no row. A file modified less than ``settle_seconds`` ago is still being written
    and is left for the next cycle.
    """
    raw = (
        spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
                F.col("_metadata.file_modification_time").alias("_modified"))
    )
    return _parse(skip_unstable(raw, settle_seconds), "file")


def skip_unstable(raw: DataFrame, settle_seconds: float) -> DataFrame:
    """Drop rows of empty or recently changed files, by file metadata."""
    stable = F.col("_size") > 0
    if settle_seconds > 0:
        cutoff = F.current_timestamp() - F.make_dt_interval(secs=F.lit(settle_seconds))
        stable = stable & (F.col("_modified") <= cutoff)
    return raw.where(stable).drop("_size", "_modified")


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``file, bytes`` of the files of a folder as they are now, without reading them.

    A scan leaves files without bytes out, so that these are the names that it was planned for and did not meet.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    sizes = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    named = spark.createDataFrame([(f,) for f in found.inputFiles()], "_name string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  names and scans differ in the slashes
    met = named.join(sizes, plain("_name") == plain("file"), "left")
    return cut(met.select(F.coalesce("file", "_name").alias("file"), F.coalesce("bytes", F.lit(0)).alias("bytes")), "listing")


def compare_listings(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file, bytes, reason`` of every file of two listings; ``reason`` is why a file is not to be read, or null.

    ``empty``: no bytes; ``growing``: new in the second listing, or of another size in it; ``gone``: only in the first.
    """
    both = before.select("file", F.col("bytes").alias("_old")).join(after, "file", "full")
    reason = F.when(F.col("bytes").isNull(), "gone").when(F.col("bytes") == 0, "empty").when(~F.col("_old").eqNullSafe(F.col("bytes")), "growing")
    return both.select("file", F.coalesce("bytes", "_old").alias("bytes"), reason.alias("reason"))


def read_listed(spark: SparkSession, path: str, listed: DataFrame, log: str | None = None, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The good reports among the files of :func:`compare_listings`, with their ``file``, and the log of all others.

    The log has ``file, bytes, reason, text``: besides the reasons of the listings ``empty`` for files of white space,
    ``broken`` (with the text) for what is no JSON document, ``growing`` and ``gone`` for files that changed before they
    were read. Nothing in a file is fatal. With ``log`` the rows are added to the JSON files of that folder.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"))
    met = listed.join(raw, "file", "left")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    blank = F.trim(F.regexp_replace("value", r"\s+", " ")) == ""
    judged = met.withColumn("_r", F.when(F.col("reason").isNull() & ~blank, F.from_json("value", _SCHEMA, options)))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_size").isNull(), "gone")
        .when(F.col("_size") != F.col("bytes"), "growing").when(blank, "empty")
        .when(F.col(f"_r.{_CORRUPT}").isNotNull(), "broken")
    )
    # written, so that reports and log come from one reading of the files
    rows = cut(judged.select("file", "bytes", reason.alias("reason"), F.when(reason == "broken", F.col("value")).alias("text"), "_r"), "reports")
    skipped = rows.where(F.col("reason").isNotNull()).select("file", "bytes", "reason", "text")
    if log is not None:
        skipped.write.mode("append").json(log)
    return rows.where(F.col("reason").isNull()).select(*[f"_r.{n}" for n in REPORT.names], "file"), skipped


def read_settled_reports(spark: SparkSession, path: str, pause: float = 1.0, log: str | None = None, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Reports of the files that have the same size, above zero, before and after ``pause`` seconds; see :func:`read_listed`.

    One pause serves all files. What is skipped now is met again in the next cycle.
    """
    before = list_files(spark, path, pattern)
    time.sleep(pause)
    return read_listed(spark, path, compare_listings(before, list_files(spark, path, pattern)), log, pattern)


def write_reports(reports: DataFrame, path: str) -> str:
    """Reports as JSON lines, one document per line."""
    reports.write.mode("overwrite").json(path)
    return path


def read_report_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports packed one per line into splittable files: good ones and broken lines."""
    return _parse(spark.read.text(path))
