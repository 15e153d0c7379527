"""Content versions: fingerprints, stale stages, required outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import row_digest


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: row count and, as text, the sum of md5-derived row integers,
    which holds for more rows than a table can have."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(row_digest([F.col(c) for c in df.columns]).cast("decimal(28,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def file_manifest(spark, path: str) -> DataFrame:
    """md5 and size of every file below ``path``, hashed where the files are read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.md5("content").alias("md5"), F.col("length").alias("size"))
    )


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of (stage, path, md5) manifests that are added, removed or modified."""
    a = old.select("stage", "path", F.col("md5").alias("old_md5"))
    b = new.select("stage", "path", F.col("md5").alias("new_md5"))
    both = a.join(b, ["stage", "path"], "full").where(~F.col("old_md5").eqNullSafe(F.col("new_md5")))
    change = F.when(F.col("old_md5").isNull(), "added").when(F.col("new_md5").isNull(), "removed").otherwise("modified")
    return both.select("stage", "path", change.alias("change"))


def stale_stages(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """Stages to run again: those with a changed dependency, and everything downstream of them."""
    from tidemark.operators.lineage import reachable

    seeds = changed_paths(old, new).select(F.col("stage").alias("node")).distinct()
    return reachable(edges, seeds).select(F.col("node").alias("stage"), (F.col("depth") == 0).alias("changed"))


def missing_paths(required: DataFrame, present: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Required rows with no counterpart."""
    return required.join(present, list(on), "left_anti")


def require_paths(required: DataFrame, present: DataFrame, on: Sequence[str] = ("path",)) -> None:
    """Raise when anything required is missing; only a short sample is brought back for the message."""
    lost = missing_paths(required, present, on)
    sample = lost.select(*on).limit(5).collect()
    if sample:
        raise ValueError(f"missing before publication, for example {[tuple(r) for r in sample]}")


def violations(df: DataFrame, checks: dict) -> DataFrame:
    """Pre-publication checks: each maps a table to its offending rows; the result is (check, n)."""
    parts = [check(df).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, check in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")
