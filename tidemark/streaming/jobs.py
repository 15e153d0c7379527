"""Stream operators: scoring, live statistics, late data, deduplication, counters, alerts, tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.operators import drift, evaluation, features, ml, stats, tseries
from tidemark.plans.blocks import TimeBlocks
from tidemark.plans.scratch import cut, tables
from tidemark.streaming.runs import each_batch


#: Versions of a state table that stay.
KEPT = 3


def score_stream(model: PipelineModel, requests: DataFrame, names: Sequence[str], model_name: str = "baseline-v1") -> DataFrame:
    """Valid requests scored as they arrive."""
    return ml.score(model, ml.valid_requests(requests, names)[0], model_name)


def profile_stream(df: DataFrame, ts: str, window: str, col: str, late: str = "1 hour") -> DataFrame:
    """Per window: count, nulls, min, max, mean of one column (bounded state: one row per open window)."""
    return (
        df.withWatermark(ts, late).groupBy(F.window(ts, window)["start"].alias("window_start"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(col).isNull()).alias("nulls"), F.min(col).alias("min"),
             F.max(col).alias("max"), F.avg(col).alias("mean"))
    )


def profile_batches(df: DataFrame, out: str, checkpoint: str, cols: Sequence[str], every: str | None = None, limits: dict | None = None):
    """One mergeable profile per batch, sketches included; ``stats.merge_profiles`` gives any span of them.
    Scoring does not wait for it: it is a query of its own over the same input."""

    def work(batch: DataFrame, batch_id: int) -> None:
        stats.profile(batch, cols, limits=limits).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return each_batch(df, work, checkpoint, every)


def request_stats_stream(df: DataFrame, failed, latency: str) -> DataFrame:
    """Counters since the start."""
    return evaluation.request_stats(df, failed, latency)


def tumbling_counts(df: DataFrame, ts: str, window: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    return tseries.count_over_time(df.withWatermark(ts, late), window, by, ts)


def sliding_rate_stream(df: DataFrame, ts: str, span: int, step: int, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    return tseries.sliding_rate(df.withWatermark(ts, late), span, step, by, ts)


def reject_old(df: DataFrame, ts: str, arrived: str, max_hours: float = 168) -> tuple[DataFrame, DataFrame]:
    """Rows that arrive within ``max_hours`` of their time, and the rejected rest."""
    age = micros(F.col(arrived)) - micros(F.col(ts))
    old = age > int(max_hours * 3_600_000_000)
    return df.where(~old), df.where(old)


def reject_old_to(df: DataFrame, ts: str, arrived: str, out: str, checkpoint: str, max_hours: float = 168):
    """Both sides of :func:`reject_old` from one read of the stream, as partitions ``rejected=false|true``."""
    limit = int(max_hours * 3_600_000_000)
    marked = df.withColumn("rejected", micros(F.col(arrived)) - micros(F.col(ts)) > limit)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("rejected").parquet(f"{out}/batch={batch_id}")

    return each_batch(marked, work, checkpoint)


def dedup_stream(df: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """One row per id on an at-least-once input; ids are remembered for the watermark delay."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def retention(df: DataFrame, ts: str, as_of: str, hours: float = 720) -> DataFrame:
    """Rows not older than the period."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours))))


def apply_retention(spark, source: str, out: str, ts: str, as_of: str, hours: float = 720, period: str = "day") -> str:
    """Rewrite a ``dt``-partitioned table without its expired periods; those folders are not even listed for reading."""
    end = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))
    kept = retention(spark.read.parquet(source).where(F.col("dt").cast("timestamp_ntz") >= F.date_trunc(period, end).cast("timestamp_ntz")), ts, as_of, hours)
    kept.write.mode("overwrite").partitionBy("dt").parquet(out)
    return out


def drop_expired(spark, table: str, ts: str, as_of: str, hours: float = 720) -> dict[str, int]:
    """Remove what is older than the period from a table partitioned by day (``dt=yyyy-mm-dd``), in place.

    Folders of expired days are deleted and only the day in which the period begins is written again, so the cost
    follows what goes, not what stays: the files of all later days are left as they are. The rewritten day is
    made beside the old one and takes its place by renaming. Returns how many folders went and were rewritten.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    begin = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    done = {"dropped": 0, "rewritten": 0}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("dt="):
            continue
        day = datetime.fromisoformat(name[3:])
        if day + timedelta(days=1) <= begin:
            fs.delete(status.getPath(), True)
            done["dropped"] += 1
        elif day < begin:
            # names with a leading underscore are no part of the table
            new, old = path(root, f"_new-{uuid.uuid4().hex}"), path(root, f"_old-{uuid.uuid4().hex}")
            rows = spark.read.parquet(status.getPath().toString())
            rows.where(F.col(ts) >= F.lit(begin.isoformat(sep=" ")).cast("timestamp_ntz")).write.parquet(new.toString())
            fs.rename(status.getPath(), old)
            fs.rename(new, status.getPath())
            fs.delete(old, True)
            done["rewritten"] += 1
    return done


def rolling_drift_stream(current: DataFrame, reference: DataFrame, out: str, checkpoint: str, ts: str, window: str, col: str,
                         bins: Sequence[float], limit: float = 0.1, every: str | None = None):
    """Each window of the stream against a fixed reference; every cycle publishes all windows' distances.

    The state holds one count per bin and window. The reference is counted once, before the stream.
    """
    base = drift.binned_counts(reference, col, bins)
    fixed = current.sparkSession.createDataFrame(base.collect(), base.schema)  # one row of counts
    start = F.window(ts, window)["start"].alias("window_start")

    def work(batch: DataFrame, batch_id: int) -> None:
        drift.binned_distance(fixed, batch, limit).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    return each_batch(drift.binned_counts(current, col, bins, [start]), work, checkpoint, every, "complete")


def _versions(spark, root: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(root)
    except AnalysisException:
        return None


def _state_before(spark, root: str, batch_id: int) -> DataFrame | None:
    """Newest state version older than this batch; a repeated batch starts from the same state again."""
    rows = _versions(spark, root)
    if rows is None:
        return None
    rows = rows.where(F.col("version") < batch_id)
    return rows.where(F.col("version") == rows.agg(F.max("version").alias("v")).scalar()).drop("version")


def _forget(spark, root: str, batch_id: int) -> None:
    """Delete versions that no reader can need: all but the newest ``KEPT`` up to this batch.

    A repeated batch needs the version before its own, and a reader that began earlier the one it began with.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {int(n[len("version="):]): s.getPath() for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("version=")}
    for number in sorted(v for v in held if v <= batch_id)[:-KEPT]:
        fs.delete(held[number], True)


def incremental_materialize(df: DataFrame, out: str, checkpoint: str, entity: str, ts: str, cols: Sequence[str]):
    """Keep the latest-value table up to date from a stream of feature rows.

    Each batch merges into the previous version and is published as the next one, so a batch that is
    repeated after a failure gives the same version. The newest ``KEPT`` versions stay.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, out, batch_id)
        merged = features.merge_latest(before, batch, entity, ts, cols)
        merged.write.mode("overwrite").parquet(f"{out}/version={batch_id}")
        _forget(spark, out, batch_id)

    return each_batch(df, work, checkpoint)


def counter_delta_stream(df: DataFrame, out: str, state: str, checkpoint: str, series: Sequence[str], ts: str = "ts",
                         value: str = "value", block: float = 3600):
    """Reset-aware growth between neighbouring samples, across batches.

    Between batches only the last sample per series is kept, as a versioned table. Inside a batch the
    work is split by series and time block, so one busy series does not sit in one task.
    """
    keep = [*series, ts, value]

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _state_before(spark, state, batch_id)
        batch.persist()
        rows = batch.select(*keep, F.lit(True).alias("_new"))
        if before is not None:
            rows = rows.unionByName(before.select(*keep, F.lit(False).alias("_new")))
        paired = tseries.previous_value(rows, series, ts, value, block)
        step = tseries.growth_step(value, F.col("previous"))
        paired.where("_new").select(*keep, step.alias("delta")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        last = rows.groupBy(*series).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))
        last.write.mode("overwrite").parquet(f"{state}/version={batch_id}")
        _forget(spark, state, batch_id)
        batch.unpersist()

    return each_batch(df, work, checkpoint)


def _run_starts(rows: DataFrame, held: DataFrame, block: float | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``_s, _us, _on``) with ``since_us``, where the run of true ones that they belong to began; and where
    every series then stands (``_s, since_us, last_us``), ``held`` being the same from before.

    Series are cut into blocks. Inside one a run begins behind the last false row; a run that reaches back to the start
    of its block takes its begin from a table with one row per (series, block).
    """
    placed = TimeBlocks(rows.select("_s", "_us"), ["_s"], "_us", block, limit).place(rows)
    inside = Window.partitionBy("_s", "_blk").orderBy("_us", "_on").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_offs", F.sum((~F.col("_on")).cast("long")).over(inside))
    local = local.withColumn("_start", F.min(F.when(F.col("_on"), F.col("_us"))).over(Window.partitionBy("_s", "_blk", "_offs")))
    ends = local.groupBy("_s", "_blk").agg(
        F.max("_offs").alias("_offs"), F.max("_us").alias("last_us"), F.max_by("_start", F.struct("_us", "_on")).alias("_end")
    )
    # what was known before is a block before all others, behind which any run begins anew
    seeds = held.select("_s", F.lit(-(1 << 63)).alias("_blk"), F.lit(1).cast("long").alias("_offs"), "last_us", F.col("since_us").alias("_end"))
    across = Window.partitionBy("_s").orderBy("_blk")
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    chained = seeds.unionByName(ends).withColumn("_chain", F.sum((F.col("_offs") > 0).cast("long")).over(upto))
    reach = Window.partitionBy("_s", "_chain").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    carried = chained.withColumn("_run", F.min("_end").over(reach)).withColumn("_before", F.lag("_run").over(across))
    stand = carried.groupBy("_s").agg(F.max_by("_run", "_blk").alias("since_us"), F.max("last_us").alias("last_us"))
    begun = local.join(carried.select("_s", "_blk", "_before"), ["_s", "_blk"])
    first = F.when(F.col("_offs") == 0, F.coalesce("_before", "_start")).otherwise(F.col("_start"))
    return begun.withColumn("since_us", F.when(F.col("_on"), first)), stand


def alert_stream(evals: DataFrame, out: str, state: str, checkpoint: str, series: str, active: str, hold: float = 300, at: str = "at",
                 idle: float | None = None, block: float | None = None, rows: int | None = None, every: str | None = None):
    """Alert state per evaluation, batch by batch: series, ``at``, ``since`` (begin of the current true run), ``state``.

    Between batches a versioned table holds one row per series: the begin of its run and its last evaluation. With
    ``idle`` a series leaves it when its last evaluation is that many seconds behind the newest of all; should it come
    back, it starts anew. An evaluation that is not after the last one of its series in an earlier batch, or is
    from before the idle limit, is late: its state is ``late`` and it changes nothing. Evaluations of one time
    and series in one batch count false ones first. ``block`` and ``rows`` are the length in seconds and the number of
    rows at which the blocks of a series are cut. A repeated batch gives the same rows and the same state.
    """
    hold_us, idle_us = int(hold * 1e6), None if idle is None else int(idle * 1e6)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _state_before(spark, state, batch_id)
        if known is None:
            known = batch.limit(0).select(F.col(series).alias("series"), *[F.lit(None).cast("long").alias(c) for c in ("since_us", "last_us")])
        held = known.select(F.struct("series").alias("_s"), "since_us", "last_us")
        newest = known.agg(F.max("last_us").alias("t")).first()["t"]
        with tables(spark):
            keyed = batch.select(F.struct(F.col(series).alias("series")).alias("_s"), micros(F.col(at)).alias("_us"), F.coalesce(F.col(active), F.lit(False)).alias("_on"))
            marked = keyed.join(held.select("_s", "last_us"), "_s", "left")
            late = F.coalesce(F.col("_us") <= F.col("last_us"), F.lit(False))
            if idle_us is not None and newest is not None:
                late = late | (F.col("_us") < newest - idle_us)
            # written, as both branches and the state are made of it
            marked = cut(marked.select("_s", "_us", "_on", late.alias("_late")), "evaluations")
            found, stand = _run_starts(marked.where(~F.col("_late")).drop("_late"), held, block, rows)
            level = F.when(~F.col("_on"), "inactive").when(F.col("_us") - F.col("since_us") >= hold_us, "firing").otherwise("pending")
            behind = marked.where("_late").select("_s", "_us", F.lit(None).cast("long").alias("since_us"), F.lit("late").alias("state"))
            named = found.select("_s", "_us", "since_us", level.alias("state")).unionByName(behind)
            when = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
            named.select(F.col("_s.series").alias(series), when("_us").alias(at), when("since_us").alias("since"), "state").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            if idle_us is not None:
                stand = stand.where(F.col("last_us") >= F.lit(stand.agg(F.max("last_us").alias("t")).first()["t"]) - idle_us)
            stand.select(F.col("_s.series").alias("series"), "since_us", "last_us").write.mode("overwrite").parquet(f"{state}/version={batch_id}")
        _forget(spark, state, batch_id)

    return each_batch(evals, work, checkpoint, every)
