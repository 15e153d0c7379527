"""Blocks of rows in time order, cut by how many rows they hold.

Every (key, period of fixed width) is a block. A period that holds more than ``rows`` rows of a key is cut again,
between its first and last row, into as many equal parts as it holds times ``rows``, and parts that are still too full
again. So a key with all rows of a table spreads over about as many blocks as it holds times ``rows``, also when
they come in a burst, while an ordinary key pays for a count of narrow rows. The cuts depend on the data alone: every
branch of a query and every retried task sees the same ones.

The counts are taken before the query is planned, by one pass over keys and times; a frame that reads no more than
one task could hold (``SMALL`` bytes) is not counted. Cuts steer balance only, results are the same for any. Without a full period, which is the
ordinary case, blocks cost the query nothing more. Otherwise the cuts are written to the shared folder, a row for each full
period, that is at most one for every ``rows`` rows; up to ``SENT`` of them are broadcast, more are joined by shuffling.

Block numbers grow with time within a key, and any time of a key, with or without a row, has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import whole
from tidemark.plans.scratch import cut

#: Rows of a key in a block, about.
ROWS = 500_000
#: Width of an uncut block in seconds.
PERIOD = 86_400.0
#: Times that a part is cut again, at most; a part shrinks to less than half each time.
LEVELS = 12
#: Bytes read up to which a frame is not counted.
SMALL = 64 << 20
#: Cuts that are sent to all tasks, at most.
SENT = 100_000


def _div(a: Column, b: Column) -> Column:
    """Floor of a / b for whole numbers that are not negative."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def _input_bytes(df: DataFrame) -> int:
    """Bytes of all tables that the frame reads, by the optimizer's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


class TimeBlocks:
    """The blocks of ``times``, whose column ``us`` holds microseconds; ``keys`` join by equality."""

    def __init__(self, times: DataFrame, keys: Sequence[str], us: str = "_us", period: float | None = None, rows: int | None = None):
        self.keys, self.width, self.cuts = list(keys), int((period or PERIOD) * 1e6), []
        if rows is None and _input_bytes(times) <= SMALL:
            return
        most = rows or ROWS
        now = times.select(*keys, F.col(us).alias("_t"), self._period(us).alias("_b"))
        for _ in range(LEVELS):
            n, low, high = F.count("*").alias("_n"), F.min("_t").alias("_low"), F.max("_t").alias("_high")
            full = now.groupBy(*keys, "_b").agg(n, low, high).where((F.col("_n") > most) & (F.col("_high") > F.col("_low")))
            parts = _div(F.col("_n") + most - 1, F.lit(most)).alias("_parts")
            cuts = cut(full.select(*keys, "_b", "_low", (F.col("_high") - F.col("_low") + 1).alias("_wide"), parts), "cuts")
            n_cuts = cuts.count()
            if not n_cuts:
                break
            self.cuts.append(F.broadcast(cuts) if n_cuts <= SENT else cuts)
            now = self._cut(now, self.cuts[-1], "_t", "inner")

    def _period(self, us: str) -> Column:
        return whole(F.col(us), self.width) * self.width

    def _cut(self, df: DataFrame, cuts: DataFrame, us: str, how: str) -> DataFrame:
        met = df.join(cuts, [*self.keys, "_b"], how)
        inside = F.least(F.greatest(F.col(us) - F.col("_low"), F.lit(0)), F.col("_wide") - 1)
        part = _div(inside * F.col("_parts"), F.col("_wide"))
        # a part is named by the time it starts at; the first one keeps the name of the whole
        start = F.col("_low") + _div(part * F.col("_wide") + F.col("_parts") - 1, F.col("_parts"))
        return met.withColumn("_b", F.when(part > 0, start).otherwise(F.col("_b"))).drop("_low", "_wide", "_parts")

    def place(self, df: DataFrame, us: str = "_us", name: str = "_blk") -> DataFrame:
        """``df`` with the block of the time in ``us``."""
        placed = df.withColumn("_b", self._period(us))
        for cuts in self.cuts:
            placed = self._cut(placed, cuts, us, "left")
        return placed.withColumnRenamed("_b", name)
