"""Model registry and experiment runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = ("None", "Staging")  # fixed values


def latest_version(versions: DataFrame, stages: Sequence[str] = CANDIDATES) -> DataFrame:
    """Per model the highest version, compared as a number, among the given stages."""
    return (
        versions.where(F.col("stage").isin(list(stages)))
        .groupBy("model").agg(F.max(F.col("version").cast("int")).alias("_v"))
        .select("model", F.col("_v").cast("string").alias("version"))
    )


def promote(versions: DataFrame, min_accuracy: float = 0.75, min_f1: float = 0.70) -> DataFrame:
    """Stages after promotion, for every model at once.

    The newest candidate is promoted when its metrics pass; only then are the old production versions
    archived. The per-model decision is one small row joined back, so a model with many versions is
    not gathered. Applying it again changes nothing further unless a new candidate passes.
    """
    newest = latest_version(versions).select("model", F.col("version").alias("_pick"))
    passed = (F.col("accuracy") >= min_accuracy) & (F.col("f1") >= min_f1)
    chosen = (
        versions.join(newest, (versions["model"] == newest["model"]) & (versions["version"] == newest["_pick"]), "left_semi")
        .where(passed).select("model", F.col("version").alias("_chosen"))
    )
    stage = (
        F.when(F.col("version") == F.col("_chosen"), "Production")
        .when(F.col("_chosen").isNotNull() & (F.col("stage") == "Production"), "Archived")
        .otherwise(F.col("stage"))
    )
    return versions.join(chosen, "model", "left").withColumn("stage", stage).drop("_chosen")


def production_model(versions: DataFrame, local_metrics: DataFrame | None = None) -> DataFrame:
    """Per model its newest production version in full, or a status saying there is none.

    ``versions`` has model, version, stage, run_id and created_at. With ``local_metrics`` (model, accuracy, f1) models
    without any registry entry fall back to it.
    """
    row = ("version", "stage", "run_id", "created_at")
    live = F.col("stage") == "Production"
    newest = F.max_by(F.when(live, F.struct(*row)), F.when(live, F.col("version").cast("int")))
    found = versions.groupBy("model").agg(newest.alias("_row"))
    status = F.when(F.col("_row").isNull(), "no_production_version").otherwise("production")
    rows = found.select("model", *[F.col("_row")[c].alias(c) for c in row], status.alias("status"))
    if local_metrics is None:
        return rows
    return local_metrics.select("model", "accuracy", "f1").join(rows, "model", "full").select(
        "model", *row, F.coalesce("status", F.lit("local_metrics_file")).alias("status"),
        F.when(F.col("status").isNull(), F.col("accuracy")).alias("accuracy"),
        F.when(F.col("status").isNull(), F.col("f1")).alias("f1"),
    )


def run_row(spark, run_id: str, name: str, params: dict, metrics: dict, tags: Sequence[str] = ()) -> DataFrame:
    """One experiment run as a row, ready to append."""
    schema = "run_id string, name string, params map<string,string>, metrics map<string,double>, tags array<string>"
    values = (run_id, name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, list(tags))
    return spark.createDataFrame([values], schema)


def compare_runs(runs: DataFrame, metrics: Sequence[str], sort_by: str | None = None, at_least: float | None = None) -> DataFrame:
    """Runs side by side, one column per named metric, optionally filtered and sorted by one of them.

    The names are given and a map already holds one value per name, so there is no shuffle to pivot.
    """
    wide = runs.select("run_id", *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])
    if at_least is not None:
        wide = wide.where(F.col(sort_by) >= at_least)
    return wide.orderBy(F.col(sort_by).desc_nulls_last(), "run_id") if sort_by else wide


def metrics_diff(before: DataFrame, after: DataFrame, key: str = "run_id") -> DataFrame:
    """Per key and metric: old value, new value, change; a metric on one side only has a null change."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode("metrics").alias("metric", name))

    both = long(before, "old").join(long(after, "new"), [key, "metric"], "full")
    return both.withColumn("change", F.col("new") - F.col("old"))
