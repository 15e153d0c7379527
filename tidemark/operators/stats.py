"""Dataset statistics, profiles and profile comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.clean import _missing, numeric_columns
from tidemark.plans.ordered import exact_quantiles


def _long(df: DataFrame, per_column: dict[str, dict[str, object]]) -> DataFrame:
    """One aggregate row of structs turned into one row per column."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in stats.items()])
            for name, stats in per_column.items()
        ]
    )
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column; NaN counts as missing.

    Moments come from one pass. ``exact`` quartiles use the distributed order of
    ``plans.ordered``; otherwise a mergeable sketch with 1/10000 rank error is used.
    """
    cols = list(cols or numeric_columns(df))
    filled = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    moments = {
        c: {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
        }
        for c, x in filled.items()
    }
    if not exact:
        for c in cols:
            for label, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
                moments[c][label] = F.percentile_approx(filled[c], p, 10000)
        return _long(df, moments)
    base = _long(df, moments)
    quartiles = (
        exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        .groupBy("column")
        .agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("q50"),
            F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q75"),
        )
    )
    return base.join(quartiles, "column", "left")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values (null or NaN) per column, columns without any left out; one pass over the data."""
    return _long(df, {c: {"nulls": F.count_if(_missing(df, c))} for c in df.columns}).where("nulls > 0")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(col))


def n_unique(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact counting goes through (column, value) pairs with map-side de-duplication, so one hot value
    costs one row per task.
    """
    if approx:
        return _long(df, {c: {"n_unique": F.approx_count_distinct(c)} for c in cols})
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (
        df.select(F.inline(pairs))
        .distinct()
        .groupBy("column")
        .agg(F.count("value").alias("n_unique"))
    )


def profile(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), bins: int = 10,
            limits: dict[str, tuple[float, float]] | None = None, sketches: bool = True) -> DataFrame:
    """Mergeable profile rows, one per (``by``..., column).

    Exact part: count, nulls (NaN too), min, max, sum, centred sum of squares, fixed-width histogram.
    Sketch part: a distinct-count sketch and, for numbers, a quantile sketch. Everything is one aggregation
    with map-side partials over (column, value) pairs, and every field can be merged later. By default all
    columns of numbers, text, booleans, dates and times are profiled. Histogram ranges are those given in
    ``limits``, else the exact range of the column, found in a pass of its own; histograms can be merged if
    they were made with the same limits.
    """
    kinds = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    cols = list(cols or [f.name for f in df.schema if isinstance(f.dataType, kinds)])
    cols = [c for c in cols if c not in by]
    numeric = set(numeric_columns(df))
    limits = _ranges(df, [c for c in cols if c in numeric], limits)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("type"),
            (F.when(~_missing(df, c), F.col(c)).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
            _missing(df, c).alias("empty"),
            F.lit(limits.get(c, (0.0, 1.0))[0]).alias("lo"),
            F.lit(limits.get(c, (0.0, 1.0))[1]).alias("hi"),
            *([F.when(~_missing(df, c), F.col(c)).cast("string").alias("text")] if sketches else []),
        )
        for c in cols
    ]
    long = df.select(*by, F.inline(F.array(*structs)))
    aggs = [
        F.count("*").alias("rows"),
        F.count_if("empty").alias("nulls"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum("number").alias("total"),
        (F.var_pop("number") * F.count("number")).alias("spread"),
    ]
    # one counter per bin, so the histogram never holds rows
    slot = F.least(F.greatest(F.width_bucket("number", "lo", "hi", F.lit(bins)), F.lit(0)), F.lit(bins + 1))
    aggs.append(F.array(*[F.count_if(slot == i) for i in range(bins + 2)]).alias("histogram"))
    if sketches:
        aggs += [F.hll_sketch_agg("text").alias("distinct_sketch"), F.kll_sketch_agg_double("number").alias("quantile_sketch")]
    return long.groupBy(*by, "column", "type").agg(*aggs)


def _ranges(df: DataFrame, cols: Sequence[str], given: dict[str, tuple[float, float]] | None) -> dict[str, tuple[float, float]]:
    """Histogram range per column: the given one, or from the smallest value to just above the largest."""
    found = dict(given or {})
    open_ = [c for c in cols if c not in found]
    if open_:
        inner = {c: F.when(~_missing(df, c), F.col(c)).cast("double") for c in open_}
        row = df.agg(*[f(inner[c]).alias(f"{n}{i}") for i, c in enumerate(open_) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, c in enumerate(open_):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is not None and math.isfinite(lo) and math.isfinite(hi):
                found[c] = (lo, math.nextafter(max(hi, lo), math.inf))
    return found


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of parts to the profile of the whole; spreads are centred anew on the common mean."""
    whole = Window.partitionBy(*by, "column", "type")
    filled = F.col("rows") - F.col("nulls")
    mean = F.try_divide(F.sum("total").over(whole), F.sum(filled).over(whole))
    shift = F.try_divide(F.col("total"), filled) - mean
    profiles = profiles.withColumn("spread", F.col("spread") + F.coalesce(filled * shift * shift, F.lit(0.0)))
    aggs = [F.sum(c).alias(c) for c in ("rows", "nulls")]
    aggs += [F.min("min").alias("min"), F.max("max").alias("max")]
    aggs += [F.sum("total").alias("total"), F.sum("spread").alias("spread")]
    if "distinct_sketch" in profiles.columns:
        aggs += [
            F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
            F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        ]
    return profiles.groupBy(*by, "column", "type").agg(*aggs)


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Readable numbers from profile rows: mean, population std, distinct estimate, quartiles."""
    filled = F.col("rows") - F.col("nulls")
    mean = F.try_divide(F.col("total"), filled)
    keep = [c for c in profiles.columns if c not in ("distinct_sketch", "quantile_sketch", "total", "spread", "histogram")]
    out = [*[F.col(c) for c in keep], mean.alias("mean"), F.sqrt(F.try_divide("spread", filled)).alias("std")]
    if "distinct_sketch" in profiles.columns:
        has = F.col("total").isNotNull()
        out += [
            F.hll_sketch_estimate("distinct_sketch").alias("cardinality"),
            *[
                F.when(has, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p))).alias(n)
                for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
            ],
        ]
    return profiles.select(*out)


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-column change between two profile sets (one row per column each)."""
    a, b = profile_summary(before), profile_summary(after)
    fields = ["rows", "nulls", "min", "max", "mean"]
    left = a.select("column", *[F.col(f).alias(f"{f}_before") for f in fields])
    right = b.select("column", *[F.col(f).alias(f"{f}_after") for f in fields])
    return left.join(right, "column", "full").withColumns(
        {
            "rows_change": F.coalesce("rows_after", F.lit(0)) - F.coalesce("rows_before", F.lit(0)),
            "mean_change": F.col("mean_after") - F.col("mean_before"),
        }
    )
