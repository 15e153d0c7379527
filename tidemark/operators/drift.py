"""Distribution drift between a reference and a current dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.special import chi2_pvalue, ks_pvalue
from tidemark.operators.clean import band, numeric_columns
from tidemark.plans.ordered import block_splits, running_sums, stack_numeric


def shared_columns(ref: DataFrame, cur: DataFrame) -> tuple[list[str], list[str]]:
    """Columns present on both sides: numeric ones and text ones."""
    both = [c for c in ref.columns if c in cur.columns]
    numeric = [c for c in both if c in set(numeric_columns(ref)) & set(numeric_columns(cur))]
    text = [c for c in both if isinstance(ref.schema[c].dataType, (T.StringType, T.BooleanType))]
    return numeric, text


def _sides(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    return ref.select(F.lit(0).alias("side"), *cols).unionAll(cur.select(F.lit(1).alias("side"), *cols))


def reference_vs_current(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Rows and mean per shared numeric column and rows per shared text column, side by side."""
    numeric, text = shared_columns(ref, cur)
    cols = [*numeric, *text]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
                F.col(c).isNotNull().alias("filled"),
            )
            for c in cols
        ]
    )
    long = _sides(ref, cur, cols).select("side", F.inline(rows))
    side = {"ref": F.col("side") == 0, "cur": F.col("side") == 1}
    return long.groupBy("column").agg(
        *[F.count_if(cond & F.col("filled")).alias(f"n_{s}") for s, cond in side.items()],
        *[F.avg(F.when(cond, F.col("number"))).alias(f"mean_{s}") for s, cond in side.items()],
    )


def _value_counts(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per distinct value and side with running totals, blocks cut on the pooled values."""
    pooled = _sides(ref, cur, cols)
    long = stack_numeric(pooled, cols, block_splits(pooled, cols), keep=["side"])
    counts = long.groupBy("column", "block", "value").agg(
        F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur")
    )
    return running_sums(counts, ["value"], ["n_ref", "n_cur"], "block", ["column"], head="value")


def drift_distances(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric column: two-sample KS statistic, its p-value, and the Wasserstein-1 distance.

    Both come from the same distributed cumulative counts over distinct values.
    """
    placed = _value_counts(ref, cur, cols)
    nxt = F.lead("value").over(Window.partitionBy("column", "block").orderBy("value"))
    gap = F.abs(F.try_divide("n_ref_upto", "n_ref_total") - F.try_divide("n_cur_upto", "n_cur_total"))
    steps = placed.select(
        "column",
        gap.alias("gap"),
        (F.coalesce(nxt, F.col("_next_head")) - F.col("value")).alias("width"),
        "n_ref_total",
        "n_cur_total",
    )
    found = steps.groupBy("column").agg(
        F.max("gap").alias("statistic"),
        F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("wasserstein"),
        F.max("n_ref_total").alias("n_ref"),
        F.max("n_cur_total").alias("n_cur"),
    )
    out = _every_column(ref, cols).join(found, "column", "left")
    p = F.when(_vanished("n_ref", "n_cur"), 0.0).otherwise(ks_pvalue(F.col("statistic"), F.col("n_ref"), F.col("n_cur")))
    return out.withColumn("p_value", F.when(F.col("n_ref").isNotNull(), p))


def _every_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per tested column, so that one without any value keeps its row."""
    return df.sparkSession.createDataFrame([(c,) for c in cols], "column string")


def _vanished(ref: str, cur: str):
    """Values on one side only: there is no statistic, and nothing left to compare, so the column has drifted."""
    return (F.coalesce(F.col(ref), F.lit(0)) > 0) != (F.coalesce(F.col(cur), F.lit(0)) > 0)


def drift_ks(ref: DataFrame, cur: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """KS test per numeric column, drifted when the p-value is below ``alpha``."""
    return drift_distances(ref, cur, cols).select(
        "column", "statistic", "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drifted")
    )


def drift_wasserstein(ref: DataFrame, cur: DataFrame, cols: Sequence[str], limit: float | None = None) -> DataFrame:
    """Wasserstein-1 distance per numeric column; a verdict only where a limit is given."""
    out = drift_distances(ref, cur, cols).select("column", F.col("wasserstein").alias("distance"))
    return out if limit is None else out.withColumn("drifted", F.col("distance") > limit)


def drift_chi2(ref: DataFrame, cur: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Chi-squared test of category counts per text column.

    Categories are counted first, so a hot category is one row per task before any shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = (
        _sides(ref, cur, cols)
        .select("side", F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur"))
    )
    totals = counts.groupBy("column").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    both = F.col("n_ref") + F.col("n_cur")
    pooled = F.col("t_ref") + F.col("t_cur")

    def part(observed: str, total: str):
        expected = both * F.col(total) / pooled
        return F.coalesce(F.try_divide((F.col(observed) - expected) * (F.col(observed) - expected), expected), F.lit(0.0))

    # totals: one row per tested column
    stat = (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(
            F.sum(part("n_ref", "t_ref") + part("n_cur", "t_cur")).alias("statistic"), (F.count("*") - 1).alias("dof"),
            F.max("t_ref").alias("t_ref"), F.max("t_cur").alias("t_cur"),
        )
    )
    gone = _vanished("t_ref", "t_cur")
    every = _every_column(ref, cols).join(stat, "column", "left").withColumn("statistic", F.when(~gone, F.col("statistic")))
    p = F.when(gone, F.lit(0.0)).otherwise(chi2_pvalue(F.col("statistic"), F.col("dof")))
    return every.withColumn("p_value", p).select(
        "column", "statistic", "dof", "p_value", F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drifted")
    )


def drift_report(ref: DataFrame, cur: DataFrame, alpha: float = 0.05, threshold: float = 0.1) -> DataFrame:
    """One row per shared column with its test, plus the share of drifted columns and the verdict.

    Numbers use KS, text and booleans use chi-squared. The verdict is strict: share > threshold.
    """
    numeric, text = shared_columns(ref, cur)
    parts = []
    fields = ["column", "method", "statistic", "p_value", "drifted"]
    if numeric:
        parts.append(drift_ks(ref, cur, numeric, alpha).withColumn("method", F.lit("ks")).select(*fields))
    if text:
        parts.append(drift_chi2(ref, cur, text, alpha).withColumn("method", F.lit("chi2")).select(*fields))
    if not parts:
        raise ValueError("the two datasets share no testable column")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # one row per column of the table: gathering them is bounded by the schema
    whole = rows.groupBy().agg(
        F.collect_list(F.struct(*fields)).alias("_rows"), F.avg(F.col("drifted").cast("double")).alias("drift_share")
    )
    return whole.select(F.inline("_rows"), "drift_share").withColumn(
        "dataset_drift", F.col("drift_share") > F.lit(threshold)
    )


def drift_share(rows: DataFrame, by: Sequence[str] = (), threshold: float = 0.1) -> DataFrame:
    """Drifted columns over all columns."""
    return rows.groupBy(*by).agg(F.avg(F.col("drifted").cast("double")).alias("drift_share")).withColumn(
        "dataset_drift", F.col("drift_share") > F.lit(threshold)
    )


def drift_status(summaries: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Status and explanation per summary row; ``has_report`` false means no report was written."""
    # fixed values: status words and texts
    share = F.coalesce(F.col("drift_share"), F.lit(0.0))
    drifted = share > threshold
    status = F.when(~F.col("has_report"), "no_report").when(drifted, "drift_detected").otherwise("healthy")
    head = F.format_string(
        "Drifted features: %.1f%% (limit %.0f%%). ", share * 100, F.lit(threshold * 100)
    )
    tail = F.when(drifted, "Train again.").otherwise("The model can stay.")
    text = F.when(~F.col("has_report"), "There is no report to judge by.").otherwise(F.concat(head, tail))
    return summaries.withColumns({"status": status, "explanation": text})


def retrain_decision(datasets: DataFrame, summaries: DataFrame, key: str = "dataset", threshold: float = 0.1) -> DataFrame:
    """Per dataset: retrain when its share is above the threshold; no summary means no."""
    return datasets.join(summaries, key, "left").select(
        key, "drift_share", (F.coalesce("drift_share", F.lit(0.0)) > threshold).alias("retrain")
    )


def binned_counts(df: DataFrame, col: str, bins: Sequence[float], by: Sequence = ()) -> DataFrame:
    """Cumulative rows per bin (``c0`` below the first bound, ``c1`` below the second, ...) and ``n``."""
    bounds = [float("-inf"), *bins]
    slot = F.coalesce(band(F.col(col), bins), F.lit(float("-inf")))
    counters = [F.count_if(slot <= b).alias(f"c{i}") for i, b in enumerate(bounds)]
    return df.groupBy(*by).agg(*counters, F.count("*").alias("n"))


def binned_distance(reference: DataFrame, counts: DataFrame, limit: float = 0.1) -> DataFrame:
    """Largest difference of the binned distribution functions, for each row of counts against the one
    row of the reference, which enters as a scalar value."""
    names = [c for c in reference.columns if c != "n"]
    ref = reference.select(F.struct(*names, "n")).scalar()
    gaps = [F.abs(F.try_divide(F.col(c), F.col("n")) - F.try_divide(ref[c], ref["n"])) for c in names]
    keep = [c for c in counts.columns if c not in names]
    return counts.select(*keep, F.greatest(*gaps).alias("distance")).withColumn("drifted", F.col("distance") > limit)


def windowed_drift(df: DataFrame, ts: str, window: str, baseline, col: str, bins: Sequence[float], limit: float = 0.1) -> DataFrame:
    """Fixed baseline against each window of recent data, on pre-binned counts.

    ``baseline`` is a predicate naming the reference rows. A window needs one count per bin, so all of
    them together cost one aggregation.
    """
    start = F.window(ts, window)["start"].alias("window_start")
    return binned_distance(binned_counts(df.where(baseline), col, bins), binned_counts(df.where(~baseline), col, bins, [start]), limit)
