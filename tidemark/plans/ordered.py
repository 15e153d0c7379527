"""Global order statistics without a single-task window.

A window over ``ORDER BY v`` with no partitioning puts all rows into one task. Here the value range
is first cut into blocks at approximate quantiles. The cut points are a few numbers per shuffle
partition and are fixed before the query is planned, so every branch of a query, and every retry of
a lost task, sees the same blocks. Sums run inside a block; a table with one row per block carries
the offsets. The cut points only steer balance: results are exact for any choice of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks per shuffle partition: blocks are hashed to partitions, and several per partition even them out.
PER_PARTITION = 3


def block_count(df: DataFrame) -> int:
    """A few blocks per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return PER_PARTITION * partitions if partitions > 1 else 1


def block_splits(df: DataFrame, cols: Sequence[str], blocks: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles per column, as strictly increasing cut points with infinite ends.

    One pass over the named columns builds mergeable sketches, first per group of input partitions and
    then of those, so no task receives a sketch from every input task.
    """
    blocks = blocks or block_count(df)
    infinite = (float("-inf"), float("inf"))
    if blocks < 2:
        return {c: list(infinite) for c in cols}
    size = F.lit(min(65_535, max(200, 4 * blocks)))
    probs = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    numbers = [F.col(c).cast("double") for c in cols]
    finite = df.select(*[F.when(~n.isin(*infinite) & ~F.isnan(n), n).alias(f"_c{i}") for i, n in enumerate(numbers)])
    names = finite.columns
    parts = finite.groupBy((F.spark_partition_id() % 512).alias("_p")).agg(
        *[F.kll_sketch_agg_double(n, size).alias(n) for n in names], *[F.count(n).alias(f"_n{n}") for n in names]
    )
    whole = parts.agg(*[F.kll_merge_agg_double(n, size).alias(n) for n in names], *[F.sum(f"_n{n}").alias(f"_n{n}") for n in names])
    found = whole.select(*[F.when(F.col(f"_n{n}") > 0, F.kll_sketch_get_quantile_double(n, probs)).alias(n) for n in names]).first()
    return {c: [infinite[0], *sorted(set(found[n] or ())), infinite[1]] for c, n in zip(cols, names)}


def add_blocks(df: DataFrame, splits: dict[str, list[float]], prefix: str = "_blk_") -> DataFrame:
    """Add ``<prefix><col>``: the block number of each listed numeric column, null for null."""
    for i, (name, cuts) in enumerate(splits.items()):
        if len(cuts) == 2:
            df = df.withColumn(prefix + name, F.when(F.col(name).isNotNull(), F.lit(0)))
            continue
        raw = f"_raw_{i}"
        stage = Bucketizer(splits=cuts, inputCol=raw, outputCol=prefix + name, handleInvalid="keep")
        df = stage.transform(df.withColumn(raw, F.col(name).cast("double"))).drop(raw)
        df = df.withColumn(prefix + name, F.when(F.col(name).isNotNull(), F.col(prefix + name).cast("int")))
    return df


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    measures: Sequence[str],
    block: str,
    groups: Sequence[str] = (),
    head: str | None = None,
) -> DataFrame:
    """Add ``<m>_upto`` (inclusive running sum) and ``<m>_total`` for each measure.

    ``block`` must be non-decreasing in the order within a group. The offset table has one row per
    (group, block); the rows are hashed by the same columns already, so meeting it moves only that table. With ``head`` set,
    ``_next_head`` holds the smallest value of that column in the following block.
    """
    groups = list(groups)
    heads = [F.min(head).alias("_head")] if head else []
    totals = df.groupBy(*groups, block).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures], *heads)
    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = across.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    extra = {}
    for m in measures:
        extra[f"_before_{m}"] = F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0))
        extra[f"{m}_total"] = F.sum(f"_t_{m}").over(across)
    if head:
        extra["_next_head"] = F.lead("_head").over(across.orderBy(block))
    offsets = totals.withColumns(extra).drop(*[f"_t_{m}" for m in measures], "_head")

    inside = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({f"_in_{m}": F.sum(m).over(inside) for m in measures})
    joined = local.join(offsets, [*groups, block])
    done = joined.withColumns({f"{m}_upto": F.col(f"_in_{m}") + F.col(f"_before_{m}") for m in measures})
    return done.drop(*[f"_in_{m}" for m in measures], *[f"_before_{m}" for m in measures])


def row_ranks(df: DataFrame, order: Sequence[Column | str], block: str, name: str = "_rank") -> DataFrame:
    """Zero-based position of each row in the global order, as a long; also ``_rows``, the row count."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(one, order, ["_one"], block)
    return ranked.withColumns({name: F.col("_one_upto") - 1, "_rows": F.col("_one_total")}).drop(
        "_one", "_one_upto", "_one_total"
    )


def stack_numeric(df: DataFrame, cols: Sequence[str], splits: dict[str, list[float]], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., column, value, block)`` of numeric columns; nulls and NaN are left out."""
    wide = add_blocks(df.select(*keep, *cols), splits)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.col(f"_blk_{c}").alias("block")
            )
            for c in cols
        ]
    )
    # the block test says nothing new, but it keeps both uses of a running sum the same plan, so that
    # their common shuffle runs once
    return wide.select(*keep, F.inline(rows)).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("block").isNotNull())


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns: ``column, prob, quantile``.

    Equal values collapse to one row with a count before the order is taken, and only the rows that
    hold a wanted position leave their block.
    """
    long = stack_numeric(df, cols, block_splits(df, cols))
    counts = long.groupBy("column", "block", "value").agg(F.count("*").alias("n"))
    placed = running_sums(counts, ["value"], ["n"], "block", ["column"])
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1

    def near(p: Column) -> Column:
        exact = p * (F.col("n_total") - 1)
        return ((F.floor(exact) >= first) & (F.floor(exact) <= last)) | ((F.ceil(exact) >= first) & (F.ceil(exact) <= last))

    hits = placed.where(F.size(F.filter(wanted, near)) > 0).select(
        "column", "value", "n", "n_upto", "n_total", F.explode(F.filter(wanted, near)).alias("prob")
    )
    exact = F.col("prob") * (F.col("n_total") - 1)
    low = F.min("value")
    high = F.max("value")
    return (
        hits.withColumn("_frac", exact - F.floor(exact))
        .groupBy("column", "prob")
        .agg(F.when(low == high, low).otherwise(low + (high - low) * F.max("_frac")).alias("quantile"))
    )
