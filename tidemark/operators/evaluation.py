"""Classifier evaluation from labels, predictions and scores; everything starts from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import add_blocks, block_splits, running_sums


def confusion_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Rows per (actual, predicted) pair: the only pass over the data that the metrics need."""
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, y: str, pred: str, digits: int = 4) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(y) == F.col(pred)).cast("double")), digits).alias("accuracy"))


def per_class(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, support per class from confusion counts; undefined ratios are 0."""
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    return sums.select(
        "class",
        F.coalesce(F.try_divide("hit", "guessed"), zero).alias("precision"),
        F.coalesce(F.try_divide("hit", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("guessed")), zero).alias("f1"),
        "support",
    )


def f1_weighted(df: DataFrame, y: str, pred: str, digits: int = 4) -> DataFrame:
    """Support-weighted mean of the per-class F1."""
    classes = per_class(confusion_counts(df, y, pred))
    return classes.agg(F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), digits).alias("f1"))


def classes(df: DataFrame, y: str) -> DataFrame:
    """Sorted distinct labels."""
    return df.select(F.col(y).alias("class")).distinct().orderBy("class")


def confusion_matrix(df: DataFrame, y: str, pred: str, labels: Sequence = ()) -> DataFrame:
    """Rows actual, one column ``pred_<label>`` per class; every class of either side, and every given one, is on both."""
    spark = df.sparkSession
    counts = confusion_counts(df, y, pred)
    pairs = counts.select(F.explode(F.array("actual", "predicted")).alias("c")).where("c IS NOT NULL").distinct()
    labels = sorted({*labels, *(r["c"] for r in pairs.collect())})  # one value per class
    frame = spark.createDataFrame([(v,) for v in labels], counts.select("actual").schema)
    wide = counts.groupBy("actual").agg(
        *[F.sum(F.when(F.col("predicted") == v, F.col("n")).otherwise(0)).alias(f"pred_{v}") for v in labels]
    )
    return frame.join(wide, "actual", "left").na.fill(0)


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per-class rows plus accuracy, macro average and weighted average."""
    counts = confusion_counts(df, y, pred)
    rows = per_class(counts)
    body = rows.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    summary = rows.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"{kind} avg").alias("label"), F.col(f"{kind}_precision").alias("precision"),
                             F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"), F.col("support"))
                    for kind in ("macro", "weighted")
                ]
            )
        )
    )
    overall = counts.agg(
        F.lit("accuracy").alias("label"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"),
        F.sum("n").alias("support"),
    )
    return body.unionByName(summary).unionByName(overall)


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties given their mid-rank.

    Scores collapse to (score, positives, negatives) before the distributed running sum.
    """
    base = df.select(F.col(y).alias("_y"), F.col(score).cast("double").alias("_s"))
    blocked = add_blocks(base, block_splits(base, ["_s"])).where(F.col("_blk__s").isNotNull())
    counts = blocked.groupBy("_blk__s", "_s").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
    )
    placed = running_sums(counts, ["_s"], ["neg", "pos"], "_blk__s")
    below = F.col("neg_upto") - F.col("neg") / 2
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return placed.agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("roc_auc"))


def quality_gate(runs: DataFrame, min_accuracy: float = 0.75, min_f1: float = 0.70) -> DataFrame:
    """Both metrics at or above their minimum; null where a metric is missing."""
    both = F.col("accuracy").isNotNull() & F.col("f1").isNotNull()
    return runs.withColumn(
        "passed_gates", F.when(both, (F.col("accuracy") >= min_accuracy) & (F.col("f1") >= min_f1))
    )


def gate_branch(runs: DataFrame, min_accuracy: float = 0.70, min_f1: float = 0.65) -> DataFrame:
    """Follow-up step per run; missing metrics skip registration."""
    passed = (F.col("accuracy") >= min_accuracy) & (F.col("f1") >= min_f1)
    return runs.withColumn(
        "next_step", F.when(F.coalesce(passed, F.lit(False)), "register_model").otherwise("skip_registration")
    )


def evaluation_row(df: DataFrame, y: str, pred: str, min_accuracy: float = 0.75, min_f1: float = 0.70) -> DataFrame:
    """The five-field evaluation record, metrics rounded to four digits before the gate."""
    counts = confusion_counts(df, y, pred)
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    f1 = per_class(counts).agg(F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("f1"))
    both = counts.agg(F.round(hits / F.sum("n"), 4).alias("accuracy")).withColumn("f1", f1.scalar())
    gated = quality_gate(both, min_accuracy, min_f1)
    return gated.withColumns({"min_accuracy": F.lit(min_accuracy), "min_f1": F.lit(min_f1)})


def request_stats(df: DataFrame, failed, latency: str, by=()) -> DataFrame:
    """Predictions, errors and mean latency of the successes (0.0 when there are none)."""
    ok = ~failed
    return df.groupBy(*by).agg(
        F.count_if(ok).alias("predictions"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col(latency))), 2), F.lit(0.0)).alias("avg_latency_ms"),
    )
