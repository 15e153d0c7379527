"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _either(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u, v``: each of the pairs of columns of every row, in a single pass over the rows."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``), where root is the smallest node it reaches.

    Every round is two shuffled aggregations and joins over the edges and is written to the shared
    folder, so that lost executors repeat a round at most. The edge count never grows, and the number
    of rounds is logarithmic in the longest path. A hub is only ever reduced by ``min`` or met in an
    ordinary join, which adaptive execution splits.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = _either(now, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # no more rows than edges, so that those that repeat can stay until the last step
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(best, "u").select("u", "m", F.greatest("v", "m").alias("high"), F.least("v", "m").alias("low"))
        small = _either(met, ("high", "low"), ("u", "m")).where(F.col("u") != F.col("v")).distinct()
        now = cut(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        now.select("v", "v").distinct()
    ).toDF("node", "root")
