"""The training job: prepare, features, split, train, evaluate, gate, lineage."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, evaluation, lineage, ml
from tidemark.plans.scratch import scratch_dir
from tidemark.sources.tables import append_rows, write_json_row, write_table


@dataclass
class Params:
    """Settings of a training run; the defaults scale and encode nothing."""

    target: str = "target"
    key: str = "row_key"
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    test_size: float = 0.2
    seed: int = 42
    trees: int = 100
    depth: int = 5
    fit_on: str = "all"
    min_accuracy: float = 0.75
    min_f1: float = 0.70


@dataclass
class TrainingResult:
    model: object
    evaluation: DataFrame
    stages: DataFrame
    folder: str


def _now() -> Column:
    """The time of this call, not of the query that uses it."""
    return F.timestamp_micros(F.lit(int(time.time() * 1e6)))


def train(source: DataFrame, params: Params | None = None, folder: str | None = None, run_id: str = "run") -> TrainingResult:
    """Run every stage; only published tables are materialised.

    The lineage gets a START before the first stage and a COMPLETE behind the last, each with its own time, so a run
    that failed shows as a START alone.

    The feature table is written once to the shared folder, and training, scoring and lineage all read
    it from there. ``fit_on='train'`` fits scaler and encoder on the train part only.
    """
    p = params or Params()
    spark = source.sparkSession
    folder = folder or scratch_dir(spark, "training")
    job = F.lit(run_id).alias("run_id"), F.lit("training.train").alias("job"), F.array(F.lit("features")).alias("inputs"), F.array(F.lit("model")).alias("outputs")
    started = _now().alias("started")
    begun = spark.range(1).select(*job, started, F.lit(None).cast("timestamp").alias("ended"))
    append_rows(lineage.lineage_events(begun), f"{folder}/lineage")
    dropped = clean.dropped_row_count(source)
    prepared, _ = clean.normalise_columns(clean.drop_null_rows(source))

    flag = ml.split_flag(F.col(p.key), p.test_size, p.seed)
    basis = prepared if p.fit_on == "all" else prepared.where(~flag)
    built = ml.one_hot(ml.standard_scale(prepared, p.numeric, basis), p.categorical, basis)
    write_table(built.withColumn("_test", flag), f"{folder}/features")
    features = spark.read.parquet(f"{folder}/features")

    train_part, test_part = features.where(~F.col("_test")), features.where("_test")
    names = [c for c in clean.numeric_columns(features) if c not in (p.target, p.key)]
    model = ml.fit_forest(train_part, names, p.target, p.trees, p.depth, p.seed)
    ml.save_model(model, f"{folder}/model")
    scored = ml.score(model, test_part)
    write_json_row(evaluation.evaluation_row(scored, p.target, "prediction", p.min_accuracy, p.min_f1), f"{folder}/metrics")
    from tidemark.schemas import EVALUATION

    metrics = spark.read.schema(EVALUATION).json(f"{folder}/metrics")

    counts = features.agg(F.count_if(~F.col("_test")).alias("train"), F.count_if("_test").alias("test"))
    rows = [
        dropped.select(F.lit("prepare").alias("stage"), F.col("kept").alias("n_rows"), F.lit(None).cast("double").alias("value")),
        features.agg(F.lit("features").alias("stage"), F.count("*").alias("n_rows"), F.lit(float(len(names))).alias("value")),
        counts.select(F.lit("split").alias("stage"), F.col("test").alias("n_rows"), (F.col("test") / (F.col("test") + F.col("train"))).alias("value")),
        counts.select(F.lit("train").alias("stage"), F.col("train").alias("n_rows"), F.lit(float(p.trees)).alias("value")),
        metrics.select(F.lit("evaluate").alias("stage"), F.lit(None).cast("long").alias("n_rows"), F.col("accuracy").alias("value")),
        metrics.select(F.lit("gate").alias("stage"), F.lit(None).cast("long").alias("n_rows"), F.col("passed_gates").cast("double").alias("value")),
    ]
    stages = rows[0]
    for row in rows[1:]:
        stages = stages.unionByName(row)

    done = metrics.select(
        *job, started, _now().alias("ended"), counts.select("train").scalar().alias("n_rows"),
        F.create_map(F.lit("accuracy"), F.col("accuracy"), F.lit("f1"), F.col("f1")).alias("metrics"),
    )
    append_rows(lineage.lineage_events(done).where("eventType = 'COMPLETE'"), f"{folder}/lineage")
    return TrainingResult(model, metrics, stages, folder)
