"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results meet in a hash join on (conversation, identifier). Calls are put in a topological order of
their declared dependencies: where these all point back in time the order of the turns is one already; in the
conversations in which some do not, chains of single dependencies are contracted by doubling, and what is left
is ordered by levels, a round of joins for each. Arguments are parsed as
variants, checked against a schema of the tool, and written as canonical JSON: object keys sorted at every
depth, no spaces, numbers in one form. Conversations may be of any length: positions come from counts per
block of turns, and no conversation is gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut

#: Turns per block of a conversation.
BLOCK = 256

#: Argument types and what the parsed value must be.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}

#: field -> (type, required)
Schema = Mapping[str, tuple[str, bool]]


def first_of_each(rows: DataFrame, value: str) -> DataFrame:
    """Of rows that repeat an identifier in a conversation the earliest; ties by the value (null last), then by the rest."""
    others = [c for c in rows.columns if c not in ("conv_id", "call_id")]
    order = F.struct(F.col("turn"), F.col(value).isNull(), F.coalesce(F.col(value).cast("string"), F.lit("")), F.to_json(F.struct(*others)))
    best = rows.groupBy("conv_id", "call_id").agg(F.min_by(F.struct(*others), order).alias("_b"), F.count("*").alias("n"))
    return best.select("conv_id", "call_id", *[F.col("_b")[c].alias(c) for c in others], "n")


def _chains(pending: DataFrame) -> DataFrame:
    """``conv_id, call_id, to, far`` of calls with a single dependency: where the chain of such calls ends, how far.

    Every round doubles the distance. A chain that runs into a cycle of such calls goes on beyond the number of
    calls; its end is then null.
    """
    degree = pending.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("dep").alias("to")).where("n = 1")
    now = cut(degree.select("conv_id", "call_id", "to", F.lit(1).cast("bigint").alias("far")), "chains")
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("then"), F.col("far").alias("more"))
        met = now.join(ahead, ["conv_id", "to"], "left")
        now = cut(met.select("conv_id", "call_id", F.coalesce("then", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("then").isNotNull().alias("moved")), "chains")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    inner = now.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("inside"))
    return now.join(inner, ["conv_id", "to"], "left").select("conv_id", "call_id", F.when(F.col("inside").isNull(), F.col("to")).alias("to"), "far")


def dependency_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level, missing`` of calls (``conv_id, call_id, turn, after``).

    Level 0 where turn order is topological already. In other conversations it is the longest path from a
    call without dependencies, and null on a cycle or behind one. ``missing`` counts the distinct identifiers
    that no call has; they hold nothing up.
    """
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("dep"))
    nodes = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"), F.lit(True).alias("known"))
    met = cut(edges.join(nodes, ["conv_id", "dep"], "left"), "edges")
    missing = met.where(F.col("known").isNull()).groupBy("conv_id", "call_id").agg(F.count("*").alias("missing"))
    real = met.where("known")
    ahead = cut(real.where(F.col("dep_turn") >= F.col("turn")).select("conv_id").distinct(), "ahead")
    mine = cut(calls.join(ahead, "conv_id", "left_semi").select("conv_id", "call_id"), "unordered")
    pending = cut(real.join(ahead, "conv_id", "left_semi").select("conv_id", "call_id", "dep"), "pending")
    chains = cut(_chains(pending), "chains")
    over = chains.select("conv_id", F.col("call_id").alias("dep"), "to", "far")
    rest = pending.join(chains, ["conv_id", "call_id"], "left_anti").join(over, ["conv_id", "dep"], "left")
    # a dependency in a chain counts as one on the chain's end; one into a cycle stays, and is never met
    rest = cut(rest.select("conv_id", "call_id", F.coalesce("to", "dep").alias("dep"), F.coalesce("far", F.lit(0)).alias("far")), "rest")
    roots = cut(mine.join(pending, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "roots")
    done, size = roots, roots.count()
    while size and not rest.isEmpty():
        reached = rest.join(done.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("below")), ["conv_id", "dep"], "left")
        ready = reached.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("below").alias("m"), F.max(F.col("below") + F.col("far")).alias("top")).where("n = m")
        done = cut(roots.union(ready.select("conv_id", "call_id", (F.col("top") + 1).cast("int"))), "levels")
        before, size = size, done.count()
        if size == before:
            break
    ends = done.select("conv_id", F.col("call_id").alias("to"), "level")
    done = done.union(chains.join(ends, ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("far")).cast("int")))
    found = mine.join(done, ["conv_id", "call_id"], "left").withColumn("_unordered", F.lit(True))
    joined = calls.select("conv_id", "call_id").join(found, ["conv_id", "call_id"], "left").join(missing, ["conv_id", "call_id"], "left")
    return joined.select("conv_id", "call_id", F.when(F.col("_unordered"), F.col("level")).otherwise(0).alias("level"), F.coalesce("missing", F.lit(0)).alias("missing"))


def argument_errors(name: Column, parsed: Column, keys: Column, schemas: Mapping[str, Schema]) -> Column:
    """Sorted list of what is wrong with the arguments of a call."""
    whole = F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False)), "arguments are no object")
    known_tool = F.coalesce(name.isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    found = [whole, F.when(~known_tool, "unknown tool")]
    extra = None
    for tool, schema in schemas.items():
        mine = F.coalesce(name == tool, F.lit(False)) & whole.isNull()
        for field, (kind, required) in schema.items():
            given = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            if required:
                found.append(F.when(mine & given.isNull(), f"missing {field}"))
            found.append(F.when(mine & given.isNotNull() & ~given.rlike(f"^({KINDS[kind]})$"), f"{field} is no {kind}"))
        more = F.transform(F.array_except(keys, F.array(*map(F.lit, schema)) if schema else F.array().cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        extra = F.when(mine, more) if extra is None else extra.when(mine, more)
    listed = F.array_compact(F.array(*found))
    return F.array_sort(F.concat(listed, F.coalesce(extra, F.array().cast("array<string>"))) if extra is not None else listed)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """One row per call: ``conv_id, call_id, turn, position, level, result_turn, n_calls, n_results, errors, json``.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (ids it depends on). ``results``:
    conv_id, turn, call_id, output. ``position`` (from 0) is a topological order of a conversation, null on
    or behind a cycle. A repeated identifier means its earliest call and its earliest result; ``n_calls`` and
    ``n_results`` count them. Calls without conversation or id can't be linked and have no row. ``errors`` also
    has ``no result``, ``repeated id``, ``cycle`` and ``unknown dependency``. ``json`` is canonical; its result
    is null where there is none, its arguments where they can't be parsed. Other columns are left aside.
    """
    asked = first_of_each(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after").where("conv_id IS NOT NULL AND call_id IS NOT NULL"), "arguments").withColumnRenamed("n", "n_calls")
    asked = cut(asked, "calls")
    given = first_of_each(results.select("conv_id", "call_id", F.col("turn"), "output").where("conv_id IS NOT NULL AND call_id IS NOT NULL"), "output")
    given = given.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "output", F.col("n").alias("n_results"))
    linked = asked.join(given.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(dependency_levels(asked), ["conv_id", "call_id"])
    linked = linked.withColumns({"_parsed": F.try_parse_json("arguments"), "n_results": F.coalesce("n_results", F.lit(0))})
    linked = linked.withColumn("_keys", F.coalesce(F.json_object_keys(F.to_json("_parsed")), F.array().cast("array<string>")))
    link_errors = F.array_compact(
        F.array(
            F.when(F.col("n_results") == 0, "no result"), F.when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated id"),
            F.when(F.col("level").isNull(), "cycle"), F.when(F.col("missing") > 0, "unknown dependency"),
        )
    )
    errors = F.array_sort(F.concat(argument_errors(F.col("name"), F.col("_parsed"), F.col("_keys"), schemas), link_errors))
    body = F.to_json(F.struct(F.col("_parsed").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("output").alias("result")), {"ignoreNullFields": "false"})
    linked = cut(linked.select("conv_id", "call_id", "turn", "level", "result_turn", "n_calls", "n_results", errors.alias("errors"), body.alias("json"), F.floor(F.col("turn") / BLOCK).alias("_block")), "linked")

    placed = linked.where(F.col("level").isNotNull()).select("conv_id", "level", "_block", F.coalesce("_block", F.lit(-1)).alias("_b"), "turn", "call_id")
    counts = placed.groupBy("conv_id", "level", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("level", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("conv_id", "level", "_b").orderBy("turn", "call_id")
    ranks = placed.withColumn("_i", F.row_number().over(inside)).join(offsets, ["conv_id", "level", "_b"]).select("conv_id", "call_id", (F.col("_before") + F.col("_i") - 1).alias("position"))
    return linked.join(ranks, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "turn", "position", "level", "result_turn", "n_calls", "n_results", "errors", "json")
