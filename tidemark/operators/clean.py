"""Cleaning and shaping of tabular datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.ordered import add_blocks, block_splits, row_ranks


def _missing(df: DataFrame, name: str) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop every row with a null (or NaN) in any column."""
    return df.na.drop("any")


def dropped_row_count(df: DataFrame) -> DataFrame:
    """One row: rows before, rows kept, rows dropped by :func:`drop_null_rows`, in a single pass."""
    bad = F.lit(False)
    for name in df.columns:
        bad = bad | _missing(df, name)
    return df.agg(
        F.count("*").alias("before"),
        F.count_if(~bad).alias("kept"),
        F.count_if(bad).alias("dropped"),
    )


def normalised(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_columns(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Trim, lower-case and underscore the column names; also returns the renames made."""
    names = [normalised(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after normalising: {twice}")
    return df.toDF(*names), [(a, b) for a, b in zip(df.columns, names) if a != b]


def split_xy(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Features and target as two projections of the same plan."""
    if target not in df.columns:
        raise ValueError(f"no target column {target!r} in {df.columns}")
    return df.drop(target), df.select(target)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def add_row_id(df: DataFrame, order_by: str, name: str = "row_id") -> DataFrame:
    """Dense ids 0..n-1 in the order of a unique numeric column, without a one-task sort."""
    splits = block_splits(df, [order_by])
    blocked = add_blocks(df, splits).withColumn("_blk", F.coalesce(F.col(f"_blk_{order_by}"), F.lit(-1)))
    ranked = row_ranks(blocked.drop(f"_blk_{order_by}"), [order_by], "_blk", name)
    return ranked.select(name, *df.columns)


def stamp_event_time(df: DataFrame, ts=None, name: str = "event_timestamp") -> DataFrame:
    """One UTC timestamp for the whole batch."""
    value = F.current_timestamp() if ts is None else F.lit(ts)
    return df.withColumn(name, value.cast("timestamp_ntz"))


def feature_view(
    df: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    features: Sequence[str],
) -> DataFrame:
    """Apply a user transform and keep the keys and the features, the latter as doubles."""
    out = df.transform(transform)
    missing = [c for c in [*keys, *features] if c not in out.columns]
    if missing:
        raise ValueError(f"transform did not produce {missing}")
    return out.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])


def organize(df: DataFrame, drop: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Remove bookkeeping columns and give display names."""
    return df.drop(*drop).withColumnsRenamed(rename or {})


def band(value: Column, steps: Sequence[float]) -> Column:
    """Highest step not above the value; null below the first step."""
    out = F.lit(None).cast("double")
    for step in sorted(steps):
        out = F.when(value >= step, F.lit(float(step))).otherwise(out)
    return out


def null_as_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows for display in a stated order."""
    return df.orderBy(*order_by).limit(n)


def top_k(df: DataFrame, col: str, k: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest rows by one column (a distributed top-k, not a full sort)."""
    return df.orderBy(F.col(col).desc(), *ties).limit(k)
