"""Proportional stratified interleaving: shards that all match the mixture of sources.

Rows are shuffled by a seed within their source and ranked; row r of n stands at the fraction (2r + 1) / 2n.
In the order of the fractions every source is spread evenly, so pieces cut from it have, up to a row, the
same share of each. Cuts are at equal counts: shards differ by a row at most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ranks import buckets_for, running, shuffle_number
from tidemark.llm.text import with_texts
from tidemark.plans.scratch import cut

SHARDS, SEED = 16, 42


def assign(rows: DataFrame, stratum: str = "source", number: str = "number", shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps in each shard).

    ``number`` is the shuffle number of a row. Rows with a null stratum are a stratum of their own. Rows that
    repeat get slots of their own. With fewer rows than shards some shards stay empty.
    """
    carried = rows.columns
    whole = cut(rows.select(F.struct(*carried).alias("_row"), F.struct(F.col(stratum)).alias("_stratum"), F.col(number).alias("_number"), F.lit(1).alias("_one")), "rows")
    keyed = whole.select("_row", F.to_json("_stratum").alias("_stratum"), "_number", "_one")
    ranked = running(keyed, ["_stratum"], "_number", "_one")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("group_rows"))
    pieces = 1 << buckets_for(rows)
    placed = cut(ranked.select("_row", "_stratum", "_number", fraction.alias("_f")).withColumn("_piece", F.floor(F.col("_f") * pieces)), "fractions")
    sizes = placed.groupBy("_piece").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_piece")  # one row per piece
    offsets = sizes.select("_piece", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = Window.partitionBy("_piece").orderBy("_f", "_stratum", "_number")
    at = placed.withColumn("_i", F.row_number().over(inside)).join(offsets, "_piece").withColumn("_g", F.col("_before") + F.col("_i") - 1)
    shard = F.expr(f"_g * {shards} div _all")
    first = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    return at.withColumn("_shard", shard).select(*[F.col("_row")[c].alias(c) for c in carried], F.col("_shard").cast("int").alias("shard"), (F.col("_g") - first).alias("slot"))


def number(docs: DataFrame, seed: int = SEED) -> Column:
    """The shuffle number of a row, from its id and text."""
    return shuffle_number(seed, docs["doc_id"], F.md5(F.coalesce(docs["text"], F.lit(""))))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The ``docs`` (doc_id, text, source, ...) with ``shard`` and ``slot``.

    The texts move once: what decides is a narrow table, to which each text is then joined. Null and empty
    texts are rows like any other. Columns named shard or slot are replaced; any others may
    have any name.
    """
    rest = [c for c in docs.columns if c not in ("text", "shard", "slot")]
    carried = F.struct(*rest).alias("row")  # one column, so that no name can clash
    placed = assign(docs.select(carried, "doc_id", "source", F.md5("text").alias("key"), number(docs, seed).alias("shuffle")), number="shuffle", shards=shards)
    joined = with_texts(placed, docs.select("doc_id", "text"), "key")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return joined.select(*[F.col("_text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in kept], "shard", "slot")
