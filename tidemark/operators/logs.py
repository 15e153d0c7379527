"""Log lines: parsing, filtering, views, volumes and level counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.labels import label, match_labels
from tidemark.schemas import DOCKER_LINE

# fixed values: level patterns, matched anywhere in the line
ERROR = "(?i)(error|exception|fatal|panic)"
WARNING = "(?i)(warn|warning)"
INFO = "(?i)info"

CRI = r"^(\S+) (stdout|stderr) (\S+) (.*)$"  # fixed value: runtime line layout
POD_PATH = r"/var/log/pods/([^_/]+)_([^_/]+)_([^/]+)/([^/]+)/[^/]+\.log$"  # fixed value
CONTAINER_PATH = r"/var/log/containers/([^_/]+)_([^_/]+)_(.+)-([0-9a-f]+)\.log$"  # fixed value


def parse_cri(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``time stream flag message`` lines to columns, and the lines that do not fit."""
    ts = F.try_to_timestamp(F.regexp_extract(col, CRI, 1))
    parts = lines.withColumn("_ok", F.coalesce(F.col(col).rlike(CRI) & ts.isNotNull(), F.lit(False)))
    others = [c for c in lines.columns if c != col]
    good = parts.where("_ok").select(
        *others, ts.cast("timestamp_ntz").alias("ts"), F.regexp_extract(col, CRI, 2).alias("stream"),
        F.regexp_extract(col, CRI, 3).alias("flag"), F.regexp_extract(col, CRI, 4).alias("line"),
    )
    return good, parts.where(~F.col("_ok")).select(*lines.columns)


def parse_docker_json(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``{"log", "stream", "time"}`` lines to columns, and the lines that do not parse."""
    ts = F.try_to_timestamp("_j.time")
    parts = lines.withColumn("_j", F.from_json(col, DOCKER_LINE, {"mode": "PERMISSIVE"}))
    ok = F.coalesce(F.col("_j.log").isNotNull() & ts.isNotNull(), F.lit(False))
    others = [c for c in lines.columns if c != col]
    good = parts.where(ok).select(
        *others, ts.cast("timestamp_ntz").alias("ts"), F.col("_j.stream").alias("stream"),
        F.regexp_replace("_j.log", r"\n$", "").alias("line"),
    )
    return good, parts.where(~ok).select(*lines.columns)


def path_labels(df: DataFrame, path: Column | str) -> DataFrame:
    """namespace, pod, container from either log path layout; empty where neither fits."""
    path = F.col(path) if isinstance(path, str) else path
    pods = path.rlike(POD_PATH)

    def pick(first: int, second: int) -> Column:
        return F.when(pods, F.regexp_extract(path, POD_PATH, first)).otherwise(F.regexp_extract(path, CONTAINER_PATH, second))

    return df.withColumns({"namespace": pick(1, 2), "pod": pick(2, 1), "container": pick(4, 3)})


def line_filter(df: DataFrame, regex: str, line: str = "line") -> DataFrame:
    """Lines matching anywhere."""
    return df.where(F.col(line).rlike(regex))


def log_view(df: DataFrame, search: str = "", namespace: str = ".+", app: str = ".+", limit: int | None = None,
             ties: Sequence[str] = ()) -> DataFrame:
    """Newest first, case-insensitive search; empty search matches everything. Labels filter before text."""
    picked = match_labels(df, re={"namespace": namespace, "app": app})
    if search:
        picked = line_filter(picked, f"(?i){search}")
    if limit is None:
        return picked.orderBy(F.col("ts").desc(), *ties)
    return newest(picked, limit, ties=ties)


def newest(df: DataFrame, limit: int, ts: str = "ts", ties: Sequence[str] = (), period: str = "hour") -> DataFrame:
    """The ``limit`` newest rows, exactly.

    A plain ordered limit sends up to ``limit`` rows of every input task to one task. Here rows are
    counted per period first; only rows from the newest periods that together hold enough go on.
    """
    start = F.date_trunc(period, ts).cast("timestamp_ntz")
    per = df.groupBy(start.alias("_p")).agg(F.count("*").alias("_n"))
    newer = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0))
    enough = per.withColumn("_seen", newer).where(F.col("_seen") >= limit).agg(F.max("_p"))
    cutoff = F.coalesce(enough.scalar(), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    return df.where(F.col(ts) >= cutoff).orderBy(F.col(ts).desc(), *ties).limit(limit)


def level_counts(df: DataFrame, by: Sequence[str] = (), line: str = "line") -> DataFrame:
    """Errors, warnings and infos in one pass; a line may count in several."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(line).rlike(ERROR)).alias("errors"),
        F.count_if(F.col(line).rlike(WARNING)).alias("warnings"),
        F.count_if(F.col(line).rlike(INFO)).alias("infos"),
    )


def log_volume(df: DataFrame, by: str) -> DataFrame:
    """Lines per value of a label, lines without the label left out."""
    named = df.select(label(df, by).alias(by))
    return named.where(F.col(by) != "").groupBy(by).agg(F.count("*").alias("n"))
