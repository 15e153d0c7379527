"""Ranks and running sums in a seeded random order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the shuffle number.
BITS = 60


def shuffle_number(seed: Column | int, *parts: Column) -> Column:
    """A number below 2**60 that a seed and the parts (null counts as empty) determine."""
    text = F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def buckets_for(rows: DataFrame) -> int:
    """Bits of the bucket number: twice as many buckets as shuffle partitions, in each group."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, (2 * partitions - 1).bit_length())


def running(rows: DataFrame, groups: Sequence[str], number: str, measure: str, ties: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0), ``upto`` (running sum of the measure, this row included), ``group_rows`` and ``group_sum``.

    The order is that of ``number``, a shuffle number, then of ``ties``; groups must not be null. As the numbers are
    spread evenly, the leading bits deal a group, however large, into even buckets; a table with one row per
    group and bucket carries the sums of the buckets before. ``rows`` is read twice, so it should be a table.
    """
    bits = bits or buckets_for(rows)
    dealt = rows.withColumn("_bucket", F.shiftright(number, BITS - bits))
    sums = dealt.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"), F.sum(measure).alias("_s"))
    across = Window.partitionBy(*groups)
    before = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups, "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s_before"),
        F.sum("_n").over(across).alias("group_rows"),
        F.sum("_s").over(across).alias("group_sum"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(number, *ties)
    local = dealt.withColumns({"_i": F.row_number().over(inside), "_u": F.sum(measure).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    joined = local.join(offsets, [*groups, "_bucket"])
    return joined.withColumns({"rank": F.col("_n_before") + F.col("_i") - 1, "upto": F.col("_s_before") + F.col("_u")}).drop("_bucket", "_n_before", "_s_before", "_i", "_u")
