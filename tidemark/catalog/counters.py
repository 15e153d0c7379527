"""Positions inside a group for the test bindings, split into blocks so that a hot group spreads out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.plans.ordered import add_blocks, block_splits, running_sums


def _position(df: DataFrame, group: str, order: list[str], lead) -> DataFrame:
    keyed = df.withColumns({"_lead": lead, "_one": F.lit(1).cast("long")})
    blocked = add_blocks(keyed, block_splits(keyed, ["_lead"]))
    placed = running_sums(blocked, order, ["_one"], "_blk__lead", [group])
    return placed.select(*df.columns, F.col("_one_upto").alias("position"))


def position_in_kind(events: DataFrame) -> DataFrame:
    """1-based position of an event among those of its type, by time."""
    return _position(events, "event_type", ["ts", "event_id"], micros(F.col("ts")))


def version_in_model(customers: DataFrame) -> DataFrame:
    """1-based position of a customer within the nation, by key."""
    return _position(customers, "c_nationkey", ["c_custkey"], F.col("c_custkey"))
