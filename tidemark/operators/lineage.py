"""Lineage events, edges, run status and reachability."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut, scratch_dir

PRODUCER = "tidemark"


def _datasets(names: Column, namespace: str, facets: Column | None = None) -> Column:
    empty = F.lit(None).cast("struct<rowCount:bigint,customMetrics:map<string,double>>")
    return F.transform(
        names,
        lambda n: F.struct(F.lit(namespace).alias("namespace"), n.alias("name"), (empty if facets is None else facets).alias("facets")),
    )


def lineage_events(jobs: DataFrame, namespace: str = "default") -> DataFrame:
    """START and COMPLETE rows for jobs ``(run_id, job, started, ended, inputs, outputs[, n_rows, metrics])``.

    Both carry the same run id; quality facets go on the outputs of COMPLETE when metrics are present.
    A null ``ended`` gives no COMPLETE row; a null ``run_id`` gets a fresh one.
    """
    metrics = F.col("metrics") if "metrics" in jobs.columns else F.lit(None).cast("map<string,double>")
    n_rows = F.col("n_rows") if "n_rows" in jobs.columns else F.lit(None).cast("bigint")
    facets = F.when(metrics.isNotNull(), F.struct(n_rows.cast("bigint").alias("rowCount"), metrics.alias("customMetrics")))
    run = F.coalesce(F.col("run_id"), F.uuid()) if "run_id" in jobs.columns else F.uuid()

    def event(kind: str, when: str, with_facets: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("eventType"),
            F.col(when).alias("eventTime"),
            F.struct(F.col("_run").alias("runId")).alias("run"),
            F.struct(F.lit(namespace).alias("namespace"), F.col("job").alias("name")).alias("job"),
            _datasets(F.col("inputs"), namespace).alias("inputs"),
            _datasets(F.col("outputs"), namespace, facets if with_facets else None).alias("outputs"),
            F.lit(PRODUCER).alias("producer"),
        )

    pair = F.array(event("START", "started", False), event("COMPLETE", "ended", True))
    named = jobs.withColumn("_run", run)
    return named.select(F.inline(pair)).where(F.col("eventTime").isNotNull())


def lineage_edges(events: DataFrame) -> DataFrame:
    """Distinct input -> output pairs of completed runs. A run lists few datasets, so the pairs of one
    event are bounded by its own two lists."""
    done = events.where(F.col("eventType") == "COMPLETE")
    first = done.select("job.name", F.explode("inputs.name").alias("src"), "outputs")
    return first.select(F.col("name").alias("job"), "src", F.explode("outputs.name").alias("dst")).distinct()


def run_status(events: DataFrame) -> DataFrame:
    """Per run: complete or incomplete, and the duration in seconds."""
    def at(kind: str) -> Column:
        return F.when(F.col("eventType") == kind, F.col("eventTime"))

    times = events.groupBy(F.col("run.runId").alias("run_id")).agg(
        F.max(F.col("job.name")).alias("job"), F.min(at("START")).alias("started"), F.max(at("COMPLETE")).alias("ended")
    )
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6)
    return times.select(
        "run_id", "job", F.when(F.col("ended").isNull(), "incomplete").otherwise("complete").alias("status"), seconds.alias("seconds")
    )


def reachable(edges: DataFrame, seeds: DataFrame, upstream: bool = False, max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds with their smallest depth (seeds have depth 0).

    Breadth-first: each round joins only the newest level with the edges and writes the next level as
    one more ``depth=`` partition of a table in the shared folder. Every round has the same short
    plan, and a lost executor costs one round. Row data never comes to the driver; it only learns
    whether a round found anything. Cycles end by themselves; with ``max_depth`` a deeper graph is an
    error, never a shorter answer.
    """
    spark = edges.sparkSession
    src, dst = ("dst", "src") if upstream else ("src", "dst")
    steps = cut(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")))
    root = scratch_dir(spark, "walk")
    seeds.select("node").distinct().write.parquet(f"{root}/depth=0")
    for depth in count(1):
        if max_depth is not None and depth > max_depth + 1:
            raise ValueError(f"graph is deeper than {max_depth}")
        seen = spark.read.schema("node string, depth int").parquet(root)
        found = seen.where(F.col("depth") == depth - 1).join(steps, "node").select(F.col("next").alias("node")).distinct()
        level = f"{root}/depth={depth}"
        found.join(seen.select("node"), "node", "left_anti").write.parquet(level)
        if spark.read.schema("node string").parquet(level).isEmpty():
            break
    return spark.read.schema("node string, depth int").parquet(root)


def lineage_upstream(edges: DataFrame, nodes: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Everything the given nodes were made from."""
    seeds = edges.sparkSession.createDataFrame([(n,) for n in nodes], "node string")
    return reachable(edges, seeds, True, max_depth).where("depth > 0")


def lineage_downstream(edges: DataFrame, nodes: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """Everything made from the given nodes."""
    seeds = edges.sparkSession.createDataFrame([(n,) for n in nodes], "node string")
    return reachable(edges, seeds, False, max_depth).where("depth > 0")
