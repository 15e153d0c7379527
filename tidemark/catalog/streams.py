"""Queries: streams run to completion over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.governance import LATEST_SQL
from tidemark.catalog.learning import CLEAN_SQL, NAMES, small_forest
from tidemark.catalog.metrics import GROWTH, STATES_SQL, hourly
from tidemark.catalog.registry import query
from tidemark.catalog.tabular import DRIFT_BINS, PROFILE_SQL, WINDOWED_DRIFT_SQL
from tidemark.catalog.views import table, v1, v3, v4c, v6reports
from tidemark.operators import ml, reports, stats
from tidemark.plans.scratch import scratch_dir
from tidemark.sources.reports import skip_unstable
from tidemark.streaming import jobs as J
from tidemark.streaming import runs as R


def events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return R.event_time(R.read_stream(spark, f"{d}/events.parque[t]", schema))


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def complete(spark, df):
    out = scratch_dir(spark, "stream")
    R.replace_table(df, out, out + "-checkpoint")
    return R.read_latest(spark, out)


def as_stream(spark, df, name):
    """A table written to the shared folder and read back as a stream."""
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return R.read_stream(spark, path, df.schema)


@query("a5_skip_unstable_files", "SELECT count(*) AS n FROM events")
def _(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_modified")
    )
    return skip_unstable(raw, 1.0).agg(F.count("*").alias("n"))


@query("a10_read_requests", f"WITH {CLEAN_SQL} SELECT row_key, feature_1, feature_2, feature_3 FROM c")
def _(spark, d):
    good, _ = ml.valid_requests(as_stream(spark, v1(spark, d).select("row_key", *NAMES), "requests"), NAMES)
    out = scratch_dir(spark, "good")
    R.append_to(good, out, out + "-checkpoint")
    return spark.read.parquet(out)


@query("l1_score_stream")
def _(spark, d):
    model, _ = small_forest(spark, d)
    stream = as_stream(spark, v1(spark, d).select("row_key", *NAMES), "requests")
    out = scratch_dir(spark, "scored")
    R.append_to(J.score_stream(model, stream, NAMES), out, out + "-checkpoint")
    return spark.read.parquet(out).select("row_key", "prediction", "model_name")


@query("l1_score_stream_as_batch", f"WITH {CLEAN_SQL} SELECT count(*) AS n, 0::BIGINT AS differ FROM c")
def _(spark, d):
    model, _ = small_forest(spark, d, 5)
    rows = v1(spark, d).select("row_key", *NAMES)
    out = scratch_dir(spark, "scored")
    R.append_to(J.score_stream(model, as_stream(spark, rows, "requests"), NAMES), out, out + "-checkpoint")
    live = spark.read.parquet(out).select("row_key", F.col("prediction").alias("p1"))
    batch = ml.score(model, rows.na.drop("any")).select("row_key", F.col("prediction").alias("p2"))
    return live.join(batch, "row_key").agg(F.count("*").alias("n"), F.count_if(F.col("p1") != F.col("p2")).alias("differ"))


@query(
    "l2_profile_stream",
    """SELECT date_trunc('day', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS mean FROM events GROUP BY 1""",
)
def _(spark, d):
    out = complete(spark, J.profile_stream(events_stream(spark, d), "ts", "1 day", "value"))
    return ntz(out, "window_start").withColumn("mean", F.round("mean", 6))


@query(
    "l2_profile_batches",
    PROFILE_SQL
    + """SELECT "column", "type", count(*) AS "rows", count(*) FILTER (WHERE t IS NULL) AS nulls, min(x) AS "min", max(x) AS "max",
       round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM long GROUP BY 1, 2""",
)
def _(spark, d):
    out, cols = scratch_dir(spark, "profiled"), ["value", "user_id", "event_type"]
    rows = table(spark, d, "events").select("ts", *cols)
    two_steps(spark, rows, "ts", lambda s: J.profile_batches(s, out, out + "-checkpoint", cols))
    merged = stats.profile_summary(stats.merge_profiles(spark.read.parquet(out)))
    return merged.drop("cardinality", "q25", "q50", "q75").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "l3_request_stats_stream",
    """SELECT count(*) FILTER (WHERE event_type <> 'error') AS predictions, count(*) FILTER (WHERE event_type = 'error') AS errors,
       coalesce(round(avg(value) FILTER (WHERE event_type <> 'error'), 2), 0.0) AS avg_latency_ms FROM events""",
)
def _(spark, d):
    return complete(spark, J.request_stats_stream(events_stream(spark, d), F.col("event_type") == "error", "value"))


@query("l4_rolling_drift_stream", WINDOWED_DRIFT_SQL)
def _(spark, d):
    first_day = F.col("ts") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    current = events_stream(spark, d).where(~first_day)
    out = scratch_dir(spark, "rolling")
    J.rolling_drift_stream(current, table(spark, d, "events").where(first_day), out, out + "-checkpoint", "ts", "1 day", "value", DRIFT_BINS)
    return ntz(R.read_latest(spark, out), "window_start").withColumn("distance", F.round("distance", 6))


def with_arrival(df):
    return df.withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 10 * 20).cast("int")))


@query("l5_reject_old", "SELECT event_id, event_id % 10 = 9 AS rejected FROM events")
def _(spark, d):
    out = scratch_dir(spark, "aged")
    J.reject_old_to(with_arrival(events_stream(spark, d)), "ts", "arrived", out, out + "-checkpoint")
    return spark.read.parquet(out).select("event_id", F.col("rejected").cast("boolean").alias("rejected"))


@query("l5_reject_old_sides", "SELECT count(*) FILTER (WHERE event_id % 10 < 9) AS kept, count(*) FILTER (WHERE event_id % 10 = 9) AS old FROM events")
def _(spark, d):
    good, old = J.reject_old(with_arrival(table(spark, d, "events")), "ts", "arrived")
    return good.agg(F.count("*").alias("kept")).withColumn("old", old.agg(F.count("*")).scalar())


@query("l6_tumbling_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    out = complete(spark, J.tumbling_counts(events_stream(spark, d), "ts", "1 hour", ["event_type"]))
    return ntz(out, "window_start")


@query(
    "l7_sliding_rate",
    """WITH x AS (SELECT event_type, epoch_us(ts) // 30000000 AS slot FROM events), y AS (SELECT event_type, unnest(range(slot + 1, slot + 11)) AS e FROM x)
       SELECT make_timestamp(e * 30000000) AS "at", event_type, round(count(*) / 300.0, 9) AS rate FROM y GROUP BY 1, 2""",
)
def _(spark, d):
    out = complete(spark, J.sliding_rate_stream(events_stream(spark, d), "ts", 300, 30, ["event_type"]))
    return ntz(out, "at").withColumn("rate", F.round("rate", 9))


HALF = "2024-01-16 00:00:00"


def two_steps(spark, df, ts, work):
    """Run ``work(stream)`` on the first half of the rows, then again after the second half has arrived."""
    path = scratch_dir(spark, "arriving")
    for late in (False, True):
        part = (F.col(ts) >= F.lit(HALF).cast("timestamp_ntz")) == late
        df.where(part).write.mode("append").parquet(path)
        work(R.read_stream(spark, path, df.schema))


@query("l8_alert_stream", f"WITH {STATES_SQL} SELECT kind, \"at\", since, state FROM states")
def _(spark, d):
    out = scratch_dir(spark, "alerts")

    def work(stream):
        J.alert_stream(stream, out + "/rows", out + "/state", out + "/checkpoint", "kind", "active", 7200, idle=14 * 86_400)

    two_steps(spark, hourly(spark, d).select("kind", "at", "active"), "at", work)
    return spark.read.parquet(out + "/rows").drop("batch")


@query(
    "l9_counter_delta_stream",
    f"WITH s AS (SELECT kind, ts, value, lag(value) OVER (PARTITION BY kind ORDER BY ts) AS p FROM v4c) SELECT kind, ts, value, round({GROWTH}, 6) AS delta FROM s",
)
def _(spark, d):
    out = scratch_dir(spark, "deltas")

    def work(stream):
        J.counter_delta_stream(stream, out + "/rows", out + "/state", out + "/checkpoint", ["kind"])

    two_steps(spark, v4c(spark, d).select("kind", "ts", "value"), "ts", work)
    return spark.read.parquet(out + "/rows").select("kind", "ts", "value", F.round("delta", 6).alias("delta"))


@query("l10_incremental_materialize", f"WITH {LATEST_SQL} SELECT * FROM latest")
def _(spark, d):
    out = scratch_dir(spark, "online")

    def work(stream):
        J.incremental_materialize(stream, out, out + "-checkpoint", "row_id", "event_timestamp", NAMES)

    two_steps(spark, v3(spark, d), "event_timestamp", work)
    return R.read_latest(spark, out)


@query("l11_resume", "SELECT event_id, ts, value FROM events")
def _(spark, d):
    out = scratch_dir(spark, "resumed")
    two_steps(spark, table(spark, d, "events").select("event_id", "ts", "value"), "ts", lambda s: R.append_to(s, out, out + "-checkpoint"))
    return spark.read.parquet(out)


@query(
    "l12_periodic_cycle",
    """SELECT image, coalesce(severity, 'UNKNOWN') AS severity, package, count(*) AS n FROM v6
       WHERE substr(image, 5)::INT % 3 <> 0 OR severity = 'CRITICAL' GROUP BY 1, 2, 3""",
)
def _(spark, d):
    """Two cycles: before the second, reports of every third image are deleted, those with a critical finding aside."""
    out, folder = scratch_dir(spark, "cycle"), scratch_dir(spark, "reports")
    first = v6reports(spark, d)
    stays = (F.expr("substring(ArtifactName, 5)").cast("int") % 3 != 0) | F.expr("coalesce(Results[0].Vulnerabilities[0].Severity = 'CRITICAL', false)")
    for now in (first, first.where(stays)):
        now.write.mode("overwrite").parquet(folder)
        R.publish_cycle(reports.vuln_counts(reports.findings(spark.read.parquet(folder))), out)
    return R.read_latest(spark, out)


@query("l13_retention", "SELECT event_id, ts FROM events WHERE ts >= timestamp '2024-01-31 00:00:00' - INTERVAL 240 HOUR")
def _(spark, d):
    from tidemark.sources.tables import partition_by_period

    path = partition_by_period(table(spark, d, "events").select("event_id", "ts"), scratch_dir(spark, "days"))
    J.drop_expired(spark, path, "ts", "2024-01-31 00:00:00", 240)
    return spark.read.parquet(path).select("event_id", "ts")


@query("l13_retention_copy", "SELECT event_id, ts FROM events WHERE ts >= timestamp '2024-01-31 00:00:00' - INTERVAL 252 HOUR")
def _(spark, d):
    from tidemark.sources.tables import partition_by_period

    path = partition_by_period(table(spark, d, "events").select("event_id", "ts"), scratch_dir(spark, "days"))
    out = J.apply_retention(spark, path, scratch_dir(spark, "kept"), "ts", "2024-01-31 00:00:00", 252)
    return spark.read.parquet(out).select("event_id", "ts")


@query("l14_dedup_stream", "SELECT event_id, ts, value FROM events")
def _(spark, d):
    e = events_stream(spark, d).select("event_id", "ts", "value")
    out = scratch_dir(spark, "once")
    R.append_to(J.dedup_stream(e.unionAll(e), "event_id", "ts"), out, out + "-checkpoint")
    return ntz(spark.read.parquet(out), "ts")
