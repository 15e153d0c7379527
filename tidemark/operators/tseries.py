"""Metric time series: instant values, counter growth, bucket quantiles, grids and vector joins.

A series is named by ``series``, a list of columns (promoted labels, or one canonical key made with
``labels.series_key``). Times are timestamps; ranges and steps are given in seconds. One sample per
series and time is assumed.

Ordered work never takes a whole series into one task. Samples are grouped by series *and* block, and blocks
are cut by the number of rows in them (``plans.blocks``). What a block needs of those before or behind it comes from a table
with one row per (series, block): the last value before, the growth before, the first sample behind. A range may
therefore be longer than any block, and no sample is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import from_micros, micros, whole, whole_up
from tidemark.plans.blocks import TimeBlocks


def instant(df: DataFrame, series: Sequence[str], at: str, lookback: float = 300, ts: str = "ts", value: str = "value") -> DataFrame:
    """Latest sample per series at or before ``at``, at most ``lookback`` seconds old."""
    end = F.lit(at).cast("timestamp_ntz")
    start = end - F.make_dt_interval(secs=F.lit(lookback))
    live = df.where((F.col(ts) <= end) & (F.col(ts) >= start))
    return live.groupBy(*series).agg(F.max_by(value, ts).alias("value"), F.max(ts).alias("ts"))


def _growth(kind: str, value: str, previous: Column) -> Column:
    now = F.col(value)
    if kind == "increase":
        step = F.when(now < previous, now).otherwise(now - previous)
    else:
        step = F.when(now != previous, F.lit(1)).otherwise(F.lit(0)).cast("double")
    return F.coalesce(step, F.lit(0.0))


def growth_step(value: str, previous: Column) -> Column:
    """Reset-aware step from the previous sample; 0 for the first sample of a series."""
    return _growth("increase", value, previous)


def _in_blocks(df: DataFrame, series: Sequence[str], ts: str, block: float | None, rows: int | None) -> tuple[DataFrame, TimeBlocks]:
    """The samples with their microseconds, one key ``_s`` for the series (null labels included) and block."""
    keyed = df.withColumn("_us", micros(F.col(ts))).withColumn("_s", F.struct(*series))
    blocks = TimeBlocks(keyed.select("_s", "_us"), ["_s"], "_us", block, rows)
    return blocks.place(keyed), blocks


def previous_value(df: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value", block: float | None = None,
                   rows: int | None = None) -> DataFrame:
    """Add ``previous``: the value of the sample before this one in its series, however far back.

    Inside a (series, block) it is a lag; the first sample of a block takes the newest one of the
    block before, from a table with one row per (series, block). ``block`` and ``rows`` are the length in seconds
    and the number of rows at which blocks are cut.
    """
    placed, _ = _in_blocks(df, series, ts, block, rows)
    # the labels are in the key; rows that are sorted carry them, and the time, once
    slim = placed.select("_s", "_blk", *[c for c in df.columns if c not in series])
    newest = slim.groupBy("_s", "_blk").agg(F.max_by(value, ts).alias("_last"))
    carried = newest.select("_s", "_blk", F.lag("_last").over(Window.partitionBy("_s").orderBy("_blk")).alias("_carried"))
    inside = Window.partitionBy("_s", "_blk").orderBy(ts)
    lagged = slim.withColumns({"_lag": F.lag(value).over(inside), "_n": F.row_number().over(inside)})
    both = lagged.join(carried, ["_s", "_blk"])
    own = [F.col("_s")[c].alias(c) if c in series else F.col(c) for c in df.columns]
    return both.select(*own, F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias("previous"))


def _over_range(df: DataFrame, series: Sequence[str], span: float, kind: str, ts: str, value: str, block: float | None, rows: int | None) -> DataFrame:
    reach = int(span * 1e6)
    placed, blocks = _in_blocks(df, series, ts, block, rows)
    # key, time and value are all that both uses of a shuffle need, so that it runs once
    slim = placed.select("_s", "_blk", "_us", F.col(value).alias("_v"))
    inside = Window.partitionBy("_s", "_blk").orderBy("_us")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = slim.withColumn("_step", _growth(kind, "_v", F.lag("_v").over(inside))).withColumn("_inside", F.sum("_step").over(run))
    ends = local.groupBy("_s", "_blk").agg(F.min_by("_v", "_us").alias("_head"), F.max_by("_v", "_us").alias("_tail"), F.max_by("_inside", "_us").alias("_all"))
    across = Window.partitionBy("_s").orderBy("_blk")
    entered = ends.withColumn("_enter", _growth(kind, "_head", F.lag("_tail").over(across)))
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    before = entered.select("_s", "_blk", (F.sum(F.col("_all") + F.col("_enter")).over(upto) - F.col("_all")).alias("_before"))
    summed = local.join(before, ["_s", "_blk"]).withColumn("_sum", F.col("_before") + F.col("_inside"))

    # Each sample also asks, at time - range, for the first sample at or after that moment: two rows a sample,
    # each in the block of its time. Reading a block backwards turns the question into "last seen", which costs
    # the same for any range; a question behind the last sample of its block takes the first one that follows.
    asking = blocks.place(summed.withColumn("_ask_at", F.col("_us") - reach), "_ask_at", "_ask_blk")
    sample = F.struct(F.col("_blk").alias("_blk"), F.col("_us").alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast(slim.schema["_v"].dataType).alias("_v"), F.col("_sum").alias("_sum"))
    question = F.struct(F.col("_ask_blk").alias("_blk"), F.col("_ask_at").alias("_at"), F.lit(1).alias("_ask"), F.col("_v"), F.col("_sum").alias("_sum"))
    merged = asking.select("_s", F.inline(F.array(sample, question)))
    found = F.when(F.col("_ask") == 0, F.struct(F.col("_at").alias("us"), F.col("_sum").alias("sum")))
    back = Window.partitionBy("_s", "_blk").orderBy(F.col("_at").desc(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("_here", F.last(found, True).over(back))
    # the count says nothing new, but keeps the value among the columns of both uses, as above
    firsts = seen.groupBy("_s", "_blk").agg(F.min_by("_here", "_at").alias("_first"), F.count("_v").alias("_n")).where("_n >= 0")
    behind = Window.partitionBy("_s").orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select("_s", "_blk", F.last("_first", True).over(behind).alias("_next"))
    asked = seen.where("_ask = 1").join(following, ["_s", "_blk"]).withColumn("_first", F.coalesce("_here", "_next"))
    us = F.col("_at") + reach
    types = df.select(ts, value).schema
    own = [F.timestamp_micros(us).cast(types[ts].dataType).alias(ts), F.col("_v").cast(types[value].dataType).alias(value)]
    return asked.where(F.col("_first.us") < us).select(*[F.col("_s")[c].alias(c) for c in series], *own, (F.col("_sum") - F.col("_first.sum")).alias("_out"))


def increase(df: DataFrame, series: Sequence[str], span: float, ts: str = "ts", value: str = "value", block: float | None = None, rows: int | None = None) -> DataFrame:
    """Reset-corrected growth over the closed window of ``span`` seconds ending at each sample.

    A drop means the counter restarted, so the new value is the growth. No row where the window holds
    fewer than two samples, and no extrapolation to the window edges.
    """
    return _over_range(df, series, span, "increase", ts, value, block, rows).withColumnRenamed("_out", "increase")


def rate(df: DataFrame, series: Sequence[str], span: float, ts: str = "ts", value: str = "value", block: float | None = None, rows: int | None = None) -> DataFrame:
    grown = increase(df, series, span, ts, value, block, rows)
    return grown.withColumn("rate", F.col("increase") / F.lit(float(span))).drop("increase")


def changes(df: DataFrame, series: Sequence[str], span: float, ts: str = "ts", value: str = "value", block: float | None = None, rows: int | None = None) -> DataFrame:
    """Number of value changes over the closed window ending at each sample."""
    out = _over_range(df, series, span, "changes", ts, value, block, rows)
    return out.withColumn("changes", F.round("_out").cast("long")).drop("_out")


def _last_tick(df: DataFrame, ts: str, tick: int, end: str | None) -> Column:
    """Index of the last evaluation: at ``end``, or at the last sample (a scan of one column)."""
    ceiling = micros(F.lit(end).cast("timestamp_ntz")) if end else df.agg(F.max(micros(F.col(ts)))).scalar()
    return whole(ceiling, tick)


def eval_grid(df: DataFrame, series: Sequence[str], step: float, lookback: float, ts: str = "ts", value: str = "value",
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Per series and step-aligned evaluation time: ``n, total, min, max`` of the samples it can see.

    An evaluation sees ``at - lookback <= ts <= at``; those that see none have no row. Samples that the same
    evaluations see combine first (map-side), and only these sums are spread over the evaluations, so no
    ratio of look-back to step is too large and no range join is needed. Without ``end`` evaluation stops
    at the last sample.
    """
    tick, reach = int(step * 1e6), int(lookback * 1e6)
    us = micros(F.col(ts))
    first, last = whole_up(us, tick), whole(us + reach, tick)
    parts = df.groupBy(*series, first.alias("_lo"), last.alias("_hi")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    lo, hi = F.col("_lo"), F.least("_hi", _last_tick(df, ts, tick, end))
    if start:
        lo = F.greatest(lo, whole_up(micros(F.lit(start).cast("timestamp_ntz")), tick))
    spread = parts.select(*series, F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("_at"), "n", "total", "min", "max")
    sums = spread.groupBy(*series, "_at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"))
    return sums.select(*series, from_micros(F.col("_at") * tick).alias("at"), "n", "total", "min", "max")


def instant_grid(df: DataFrame, series: Sequence[str], step: float, lookback: float = 300, ts: str = "ts",
                 value: str = "value", end: str | None = None) -> DataFrame:
    """:func:`instant` at every step: latest value per series and evaluation time.

    Samples first combine to one per series and step (map-side). Each of those then answers the
    evaluations up to the next one, so the rows made are exactly the rows returned. The window is over
    steps, not samples: a series in it is no longer than the number of evaluations.
    """
    tick, reach = int(step * 1e6), int(lookback * 1e6)
    us = micros(F.col(ts))
    newest = (
        df.select(*series, us.alias("_us"), F.col(value).alias("_v"))
        .groupBy(*series, whole_up(F.col("_us"), tick).alias("_tick"))
        .agg(F.max_by("_v", "_us").alias("value"), F.max("_us").alias("_us"))
    )
    following = F.lead("_tick").over(Window.partitionBy(*series).orderBy("_tick"))
    until = F.least(whole(F.col("_us") + reach, tick), F.col("_next") - 1, _last_tick(df, ts, tick, end))
    spots = F.when(F.col("_tick") <= until, F.sequence("_tick", until))
    shown = newest.withColumn("_next", following).select(*series, F.explode(spots).alias("_at"), "value")
    return shown.select(*series, from_micros(F.col("_at") * tick).alias("at"), "value")


def increase_grid(df: DataFrame, series: Sequence[str], step: float, span: float, ts: str = "ts", value: str = "value",
                  kind: str = "increase", block: float | None = None, end: str | None = None, rows: int | None = None) -> DataFrame:
    """Growth (or ``changes``) over the last ``span`` seconds at every evaluation step.

    Steps between neighbouring samples are found inside blocks and then combine to one row per
    series and half-step (samples exactly on an evaluation time, and samples between two of them). The
    rest works on these: running sums, the evaluations each row answers, and a backward pass finding
    the first half-step inside each range. No sample is multiplied, and a series is no longer than
    twice the number of evaluations.
    """
    tick, reach = int(step * 1e6), int(span * 1e6)
    if reach % tick:
        raise ValueError("the range must be a multiple of the step")
    back_ticks = reach // tick
    paired = previous_value(df.select(*series, ts, value), series, ts, value, block, rows)
    steps = paired.withColumn("_us", micros(F.col(ts))).withColumn("_step", _growth(kind, value, F.col("previous")))
    half = whole(F.col("_us"), tick) + whole_up(F.col("_us"), tick)  # even on an evaluation time, odd between
    slots = steps.groupBy(*series, half.alias("_slot")).agg(
        F.sum("_step").alias("_all"), F.min_by("_step", "_us").alias("_lead"), F.count("*").alias("_n")
    )
    order = Window.partitionBy(*series).orderBy("_slot")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = slots.withColumns(
        {"_sum": F.sum("_all").over(upto), "_cnt": F.sum("_n").over(upto), "_next": F.lead("_slot").over(order)}
    )
    first = whole_up(F.col("_slot"), 2)
    until = F.least(whole(F.col("_slot"), 2) + back_ticks, whole_up(F.col("_next"), 2) - 1)
    answers = F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))
    fields = "struct<_key:bigint,_ask:int,_at:bigint,_base:double,_rank:bigint>"
    own = F.struct(F.col("_slot"), F.lit(0), F.lit(None), F.col("_sum") - F.col("_all") + F.col("_lead"), F.col("_cnt") - F.col("_n") + 1)
    asks = F.transform(answers, lambda g: F.struct((g - back_ticks) * 2, F.lit(1), g, F.lit(None), F.lit(None)).cast(fields))
    merged = summed.select(*series, "_sum", "_cnt", F.inline(F.concat(F.array(own.cast(fields)), asks)))
    back = Window.partitionBy(*series).orderBy(F.col("_key").desc(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumns({"_base": F.last("_base", True).over(back), "_rank": F.last("_rank", True).over(back)})
    asked = seen.where((F.col("_ask") == 1) & (F.col("_cnt") > F.col("_rank")) & (F.col("_at") <= _last_tick(df, ts, tick, end)))
    return asked.select(
        *series, from_micros(F.col("_at") * tick).alias("at"), (F.col("_sum") - F.col("_base")).alias("value")
    )


def rate_grid(df: DataFrame, series: Sequence[str], step: float, span: float, **more) -> DataFrame:
    return increase_grid(df, series, step, span, **more).withColumn("value", F.col("value") / F.lit(float(span)))


def histogram_quantile(buckets: DataFrame, q: float, series: Sequence[str], le: str = "le", count: str = "c") -> DataFrame:
    """Quantile from cumulative buckets by linear interpolation in the first bucket reaching ``q`` of the total.

    The lower bound of the first bucket is 0; a quantile in the infinite bucket gives the last finite
    bound, and null without an infinite bucket, as the total is then unknown. Buckets are first summed
    per bound, so a group holds one entry per distinct bound.
    """
    once = buckets.groupBy(*series, F.col(le).cast("double").alias("_le")).agg(F.sum(F.col(count).cast("double")).alias("_c"))
    packed = once.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("_le", "_c"))).alias("_b"))
    total = F.when(F.element_at("_b", -1)["_le"] == float("inf"), F.element_at("_b", -1)["_c"])
    rank = F.lit(float(q)) * total
    at = F.array_position(F.transform("_b", lambda b: b["_c"] >= rank), True).cast("int")
    first = F.when(at > 1, F.try_element_at("_b", F.greatest(at - 1, F.lit(1))))
    hit = F.try_element_at("_b", F.greatest(at, F.lit(1)))
    low, under = F.coalesce(first["_le"], F.lit(0.0)), F.coalesce(first["_c"], F.lit(0.0))
    inside = low + (hit["_le"] - low) * F.coalesce(F.try_divide(rank - under, hit["_c"] - under), F.lit(0.0))
    value = F.when(hit["_le"] == float("inf"), first["_le"]).otherwise(inside)
    return packed.where(F.coalesce(total, F.lit(1.0)) > 0).select(*series, F.when(total.isNotNull(), value).alias("value"))


def threshold_filter(df: DataFrame, op: str, limit: float, value: str = "value") -> DataFrame:
    """Comparison that keeps the matching series and their values."""
    v = F.col(value)
    tests = {">": v > limit, ">=": v >= limit, "<": v < limit, "<=": v <= limit, "==": v == limit, "!=": v != limit}
    return df.where(tests[op])


def time_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """``start <= ts <= end``; plain comparisons, so they reach the file scan."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= hi))


def require_unique(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The same rows; fails at run time when a label group occurs twice on this side."""
    groups = df.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in on])
    ok = F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate series in a one-to-one match"))).otherwise(F.lit(True))
    return groups.where(ok.cast("boolean")).drop("_n").select(*df.columns)


def vector_join(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """One-to-one inner match on the label columns: values as ``a`` and ``b``."""
    a = require_unique(left.select(*on, F.col(value).alias("a")), on)
    b = require_unique(right.select(*on, F.col(value).alias("b")), on)
    return a.join(b, list(on))


def vector_div(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """left / right, only where right is above zero."""
    return vector_join(left, right.where(F.col(value) > 0), on, value).select(*on, (F.col("a") / F.col("b")).alias("value"))


def vector_ne(left: DataFrame, right: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Left rows whose matched value differs."""
    return vector_join(left, right, on, value).where("a <> b").select(*on, F.col("a").alias("value"))


def vector_same_labels(left: DataFrame, right: DataFrame, op: str, value: str = "value") -> DataFrame:
    """Arithmetic between samples with exactly the same label set (``labels`` map)."""
    from tidemark.operators.labels import series_key

    a = left.select(series_key("labels").alias("series"), F.col(value))
    b = right.select(series_key("labels").alias("series"), F.col(value))
    both = vector_join(a, b, ["series"], value)
    x, y = F.col("a"), F.col("b")
    ops = {"-": x - y, "+": x + y, "*": x * y, "/": F.try_divide(x, y)}
    return both.select("series", ops[op].alias("value"))


def used_percent(total: DataFrame, available: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """(total - available) / total * 100."""
    both = vector_join(total, available, on, value)
    return both.select(*on, ((F.col("a") - F.col("b")) / F.col("a") * 100).alias("value"))


def count_over_time(df: DataFrame, step: str, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, step)["start"].alias("window_start"), *by).agg(F.count("*").alias("n"))


def sliding_rate(df: DataFrame, span: float, step: float, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows per second over the last ``span`` seconds, every ``step`` seconds.

    On a table the rows are counted per step first and only the counts are spread over the windows
    that hold them; a stream uses sliding windows directly.
    """
    if df.isStreaming or span % step:
        win = F.window(ts, f"{span} seconds", f"{step} seconds")
        return df.groupBy(win["end"].alias("at"), *by).agg((F.count("*") / F.lit(float(span))).alias("rate"))
    tick = int(step * 1e6)
    counts = df.groupBy(*by, whole(micros(F.col(ts)), tick).alias("_tick")).agg(F.count("*").alias("_n"))
    ends = F.explode(F.sequence(F.col("_tick") + 1, F.col("_tick") + int(span // step)))
    spread = counts.select(*by, ends.alias("_end"), "_n")
    out = spread.groupBy(*by, "_end").agg((F.sum("_n") / F.lit(float(span))).alias("rate"))
    return out.select(from_micros(F.col("_end") * tick).alias("at"), *by, "rate")
