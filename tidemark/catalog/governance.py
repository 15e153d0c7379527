"""Queries: feature store, registry, lineage and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import table, v1, v3, v8, v9, v10
from tidemark.operators import features as FS
from tidemark.operators import lineage as LN
from tidemark.operators import registry as RG
from tidemark.operators import versions as VS
from tidemark.plans.scratch import scratch_dir
from tidemark.sources import tables as SRC

FEATURES = ("feature_1", "feature_2", "feature_3")


@query("a1_read_csv", "SELECT row_key, feature_1, feature_2, feature_3, category, target FROM v1")
def _(spark, d):
    df = v1(spark, d)
    path = SRC.write_table(df, scratch_dir(spark, "csv"), "csv")
    return SRC.read_table(spark, path, "csv", df.schema)


@query("a1_read_csv_inferred", "SELECT * REPLACE (row_key::INT AS row_key) FROM v1")
def _(spark, d):
    path = SRC.write_table(v1(spark, d), scratch_dir(spark, "csv"), "csv")
    return SRC.read_table(spark, path, "csv")


@query("a2_write_table", "SELECT * FROM orders")
def _(spark, d):
    path = SRC.write_table(table(spark, d, "orders"), scratch_dir(spark, "orders"))
    return SRC.read_table(spark, path, "parquet")


@query("a3_write_feature_parquet", "SELECT row_id, event_timestamp, feature_1, feature_2, feature_3 FROM v3")
def _(spark, d):
    labelled = v3(spark, d).withColumn("target", F.lit(1))
    path = SRC.write_feature_parquet(labelled, scratch_dir(spark, "features"), "row_id", "event_timestamp", FEATURES)
    return spark.read.parquet(path)


@query(
    "a17_seed_zone",
    """SELECT 'features' AS zone, 'v1' AS version, 'first' AS message, count(*) AS n_rows,
       sum(('0x' || substr(md5(to_json([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::VARCHAR, o_orderdate::VARCHAR, o_orderpriority])::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM orders""",
)
def _(spark, d):
    return SRC.seed_zone(table(spark, d, "orders"), scratch_dir(spark, "zones"), "features", "v1", "first")


PIT_SQL = """f AS (SELECT user_id, ts AS fts, value AS feature_1, length(props)::DOUBLE AS feature_3 FROM events WHERE event_type = 'purchase'),
  s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')"""


def pit_inputs(spark, d):
    e = table(spark, d, "events")
    spine = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    feats = e.where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("fts"), F.col("value").alias("feature_1"), F.length("props").cast("double").alias("feature_3")
    )
    return spine, feats


@query("f4_point_in_time", f"WITH {PIT_SQL} SELECT event_id, s.user_id, ts, feature_1, feature_3 FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts >= f.fts")
def _(spark, d):
    return FS.point_in_time(*pit_inputs(spark, d), "user_id", "ts", "fts", ["feature_1", "feature_3"])


@query(
    "f4_point_in_time_ttl",
    f"""WITH {PIT_SQL} SELECT event_id, s.user_id, ts, CASE WHEN ts - fts <= INTERVAL 2 DAY THEN feature_1 END AS feature_1,
       CASE WHEN ts - fts <= INTERVAL 2 DAY THEN feature_3 END AS feature_3 FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts >= f.fts""",
)
def _(spark, d):
    return FS.point_in_time(*pit_inputs(spark, d), "user_id", "ts", "fts", ["feature_1", "feature_3"], ttl=2 * FS.DAY, block=6 * 3600)


LATEST_SQL = """latest AS (SELECT row_id, max(event_timestamp) AS event_timestamp, arg_max(feature_1, event_timestamp) AS feature_1,
  arg_max(feature_2, event_timestamp) AS feature_2, arg_max(feature_3, event_timestamp) AS feature_3 FROM v3 GROUP BY 1)"""


@query("g2_materialize_latest", f"WITH {LATEST_SQL} SELECT * FROM latest")
def _(spark, d):
    return FS.materialize_latest(v3(spark, d), "row_id", "event_timestamp", FEATURES)


@query("g2_materialize_latest_ttl", """SELECT row_id, max(event_timestamp) AS event_timestamp, arg_max(feature_1, event_timestamp) AS feature_1 FROM v3
       WHERE event_timestamp BETWEEN timestamp '2024-01-15 00:00:00' AND timestamp '2024-01-20 00:00:00' GROUP BY 1""")
def _(spark, d):
    return FS.materialize_latest(v3(spark, d), "row_id", "event_timestamp", ["feature_1"], "2024-01-20 00:00:00", 5 * FS.DAY)


@query("f5_online_lookup", f"WITH {LATEST_SQL}, k AS (SELECT DISTINCT o_custkey AS row_id FROM orders) SELECT k.row_id, event_timestamp, feature_1, feature_2, feature_3 FROM k LEFT JOIN latest ON k.row_id = latest.row_id")
def _(spark, d):
    latest = FS.materialize_latest(v3(spark, d), "row_id", "event_timestamp", FEATURES)
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("row_id")).distinct()
    return FS.online_lookup(latest, keys, "row_id")


@query("f6_training_set", "SELECT row_key, feature_1, feature_2, feature_3, target FROM v1 WHERE feature_1 IS NOT NULL AND feature_3 IS NOT NULL")
def _(spark, d):
    df = v1(spark, d)
    view = FS.FeatureView("dataset_features", "row_key", "target", FEATURES)
    feats = df.na.drop("any").select(view.entity, *view.features)
    return FS.training_set(feats, df, "row_key", "target")


@query("b8_m1_registered_view", "SELECT row_id, event_timestamp, feature_1 * 2 AS doubled FROM v3")
def _(spark, d):
    view = FS.register_view(
        FS.FeatureView("doubled", "row_id", "event_timestamp", ("doubled",), transform=lambda df: df.withColumn("doubled", F.col("feature_1") * 2))
    )
    return FS.CATALOG[view.name].rows(v3(spark, d))


# registry -----------------------------------------------------------------------------------------

NEWEST_SQL = "newest AS (SELECT model, max(version::INT)::VARCHAR AS version FROM v8 WHERE stage IN ('None', 'Staging') GROUP BY 1)"


@query("g1_latest_version", f"WITH {NEWEST_SQL} SELECT * FROM newest")
def _(spark, d):
    return RG.latest_version(v8(spark, d))


@query(
    "g3_promote",
    f"""WITH {NEWEST_SQL}, chosen AS (SELECT v8.model, v8.version FROM v8 JOIN newest ON v8.model = newest.model AND v8.version = newest.version WHERE accuracy >= 0.4 AND f1 >= 0.3)
       SELECT v8.model, v8.version, CASE WHEN v8.version = chosen.version THEN 'Production' WHEN chosen.version IS NOT NULL AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage
       FROM v8 LEFT JOIN chosen ON v8.model = chosen.model""",
)
def _(spark, d):
    return RG.promote(v8(spark, d), 0.4, 0.3).select("model", "version", "stage")


@query(
    "g4_production_model",
    """WITH v AS (SELECT model, version, stage, concat('run-', model, '-', version) AS run_id, TIMESTAMP '2024-01-01' + to_hours(version::INT) AS created_at FROM v8),
       p AS (SELECT model, max(version::INT) FILTER (WHERE stage = 'Production') AS newest FROM v GROUP BY 1),
       l AS (SELECT concat('m', n_nationkey::VARCHAR) AS model, n_regionkey / 10.0::DOUBLE AS accuracy, 0.5::DOUBLE AS f1 FROM nation
             UNION ALL SELECT concat('local', r_regionkey::VARCHAR), r_regionkey / 10.0::DOUBLE, 0.5::DOUBLE FROM region)
       SELECT l.model, v.version, v.stage, v.run_id, v.created_at,
       CASE WHEN p.model IS NULL THEN 'local_metrics_file' WHEN newest IS NULL THEN 'no_production_version' ELSE 'production' END AS status,
       CASE WHEN p.model IS NULL THEN accuracy END AS accuracy, CASE WHEN p.model IS NULL THEN f1 END AS f1
       FROM l LEFT JOIN p ON l.model = p.model LEFT JOIN v ON v.model = p.model AND v.version = newest::VARCHAR""",
)
def _(spark, d):
    def named(df, prefix, key, region):
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("model"), (F.col(region) / 10.0).alias("accuracy"), F.lit(0.5).alias("f1"))

    local = named(table(spark, d, "nation"), "m", "n_nationkey", "n_regionkey").union(named(table(spark, d, "region"), "local", "r_regionkey", "r_regionkey"))
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(version AS int))")
    versions = v8(spark, d).withColumns({"run_id": F.concat_ws("-", F.lit("run"), "model", "version"), "created_at": created})
    return RG.production_model(versions, local)


def runs(spark, d, shift=0.0):
    c = v8(spark, d)
    metrics = F.map_filter(
        F.create_map(F.lit("accuracy"), F.col("accuracy") + shift, F.lit("f1"), F.when(F.col("version").cast("int") % 4 != 0, F.col("f1"))),
        lambda _, v: v.isNotNull(),
    )
    return c.select(F.concat_ws("-", "model", "version").alias("run_id"), metrics.alias("metrics"))


@query(
    "k14_compare_runs",
    "SELECT concat(model, '-', version) AS run_id, accuracy, CASE WHEN version::INT % 4 <> 0 THEN f1 END AS f1 FROM v8 WHERE accuracy >= 0.5",
)
def _(spark, d):
    return RG.compare_runs(runs(spark, d), ["accuracy", "f1"], "accuracy", 0.5)


@query("k14_log_run", "SELECT concat(model, '-', version) AS run_id, accuracy FROM v8")
def _(spark, d):
    path = scratch_dir(spark, "runs")
    all_runs = runs(spark, d)
    for half in (0, 1):
        SRC.append_rows(all_runs.where(F.crc32("run_id") % 2 == half), path, strict=True)
    return RG.compare_runs(spark.read.parquet(path), ["accuracy"])


@query(
    "f8_metrics_diff",
    """WITH x AS (SELECT concat(model, '-', version) AS run_id, version::INT AS v, accuracy, f1 FROM v8),
       a AS (SELECT run_id, 'accuracy' AS metric, accuracy AS m FROM x WHERE v % 5 <> 0 UNION ALL SELECT run_id, 'f1', f1 FROM x WHERE v % 4 <> 0 AND v % 5 <> 0),
       b AS (SELECT run_id, 'accuracy' AS metric, accuracy + 0.1 AS m FROM x WHERE v % 7 <> 0 UNION ALL SELECT run_id, 'f1', f1 FROM x WHERE v % 4 <> 0 AND v % 7 <> 0)
       SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.metric, b.metric) AS metric, round(a.m, 9) AS old, round(b.m, 9) AS new, round(b.m - a.m, 9) AS change
       FROM a FULL JOIN b ON a.run_id = b.run_id AND a.metric = b.metric""",
)
def _(spark, d):
    number = F.split("run_id", "-")[1].cast("int")
    out = RG.metrics_diff(runs(spark, d).where(number % 5 != 0), runs(spark, d, 0.1).where(number % 7 != 0))
    return out.withColumns({c: F.round(c, 9) for c in ("old", "new", "change")})


# lineage ------------------------------------------------------------------------------------------


def jobs(spark, d):
    """One job run per order: reads a customer dataset, writes an order dataset; pending orders never end."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("job-"), (key % 40).cast("string")).alias("job"),
        F.col("o_orderdate").alias("started"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(mins=(key % 90).cast("int"))).alias("ended"),
        F.array(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")), F.lit("rates")).alias("inputs"),
        F.array(F.concat(F.lit("out-"), (key % 500).cast("string"))).alias("outputs"),
        key.alias("n_rows"),
        F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"),
    )


@query(
    "k15_lineage_events",
    """SELECT 'START' AS kind, o_orderdate AS at, concat('run-', o_orderkey::VARCHAR) AS run_id, NULL::BIGINT AS n_rows, NULL::DOUBLE AS price FROM orders
       UNION ALL SELECT 'COMPLETE', o_orderdate + to_minutes(o_orderkey % 90), concat('run-', o_orderkey::VARCHAR), o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(spark, d):
    ev = LN.lineage_events(jobs(spark, d))
    facet = F.col("outputs")[0]["facets"]
    return ev.select(F.col("eventType").alias("kind"), F.col("eventTime").alias("at"), F.col("run.runId").alias("run_id"),
                     facet["rowCount"].alias("n_rows"), F.try_element_at(facet["customMetrics"], F.lit("price")).alias("price"))


@query("a14_append_lineage", "SELECT eventType, count(*) AS n FROM (SELECT 'START' AS eventType FROM orders UNION ALL SELECT 'COMPLETE' FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark, "lineage")
    SRC.append_rows(LN.lineage_events(jobs(spark, d)), path)
    return spark.read.parquet(path).groupBy("eventType").agg(F.count("*").alias("n"))


@query(
    "g7_lineage_edges",
    """SELECT DISTINCT concat('job-', (o_orderkey % 40)::VARCHAR) AS job, unnest([concat('cust-', o_custkey::VARCHAR), 'rates']) AS src,
       concat('out-', (o_orderkey % 500)::VARCHAR) AS dst FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(spark, d):
    return LN.lineage_edges(LN.lineage_events(jobs(spark, d)))


@query(
    "g8_run_status",
    """SELECT concat('run-', o_orderkey::VARCHAR) AS run_id, concat('job-', (o_orderkey % 40)::VARCHAR) AS job,
       CASE WHEN o_orderstatus = 'P' THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 90) * 60.0::DOUBLE END AS seconds FROM orders""",
)
def _(spark, d):
    return LN.run_status(LN.lineage_events(jobs(spark, d)))


def walk_sql(start: str, frm: str, to: str) -> str:
    return f"""WITH RECURSIVE w AS (SELECT {start} AS node, 0 AS depth UNION ALL SELECT v9.{to}, w.depth + 1 FROM w JOIN v9 ON v9.{frm} = w.node WHERE w.depth < 60)
       SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY 1"""


@query("g6_lineage_upstream", walk_sql("(SELECT concat('d', max(p_partkey)::VARCHAR) FROM part)", "dst", "src").replace("JOIN v9 ON", "JOIN (SELECT * FROM v9 WHERE src <> dst) v9 ON"))
def _(spark, d):
    edges = v9(spark, d)
    last = table(spark, d, "part").agg(F.concat(F.lit("d"), F.max("p_partkey").cast("string")).alias("node"))
    return LN.reachable(edges.where("src <> dst"), last, upstream=True).where("depth > 0")


@query("g6_lineage_downstream", walk_sql("'d1'", "src", "dst"))
def _(spark, d):
    return LN.lineage_downstream(v9(spark, d), ["d1"])


# versions -----------------------------------------------------------------------------------------


def manifests(spark, d):
    m = v10(spark, d)
    old = m.where("old_md5 IS NOT NULL").select("stage", "path", F.col("old_md5").alias("md5"))
    new = m.where("new_md5 IS NOT NULL").select("stage", "path", F.col("new_md5").alias("md5"))
    return old, new


@query(
    "f7_changed_paths",
    """SELECT stage, path, CASE WHEN old_md5 IS NULL THEN 'added' WHEN new_md5 IS NULL THEN 'removed' ELSE 'modified' END AS change
       FROM v10 WHERE old_md5 IS DISTINCT FROM new_md5""",
)
def _(spark, d):
    return VS.changed_paths(*manifests(spark, d))


@query(
    "f7_stale_stages",
    """WITH RECURSIVE seed AS (SELECT DISTINCT stage FROM v10 WHERE old_md5 IS DISTINCT FROM new_md5),
       e AS (SELECT DISTINCT stage AS src, concat('s', (substr(stage, 2)::INT + 10)::VARCHAR) AS dst FROM v10),
       w AS (SELECT stage AS node, 0 AS depth FROM seed UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
       SELECT node AS stage, min(depth) = 0 AS changed FROM w GROUP BY 1""",
)
def _(spark, d):
    old, new = manifests(spark, d)
    number = F.substring("stage", 2, 10).cast("int")
    edges = v10(spark, d).select(F.col("stage").alias("src"), F.concat(F.lit("s"), (number + 10).cast("string")).alias("dst")).distinct()
    return VS.stale_stages(old, new, edges)


@query("j19_run_ids", "SELECT count(*) AS n_jobs, 2 * count(*) AS n_events, count(*) AS n_ids, 0::BIGINT AS split FROM orders")
def _(spark, d):
    """Jobs without a run id: both events of a job share a fresh one, and no two jobs do."""
    from tidemark.operators import lineage

    when = F.col("o_orderdate").cast("timestamp_ntz")
    jobs = table(spark, d, "orders").select(
        F.lit(None).cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("job"), when.alias("started"), when.alias("ended"),
        F.array(F.lit("in")).alias("inputs"), F.array(F.lit("out")).alias("outputs"),
    )
    per_job = lineage.lineage_events(jobs).groupBy("job.name").agg(F.count("*").alias("n"), F.min("run.runId").alias("a"), F.max("run.runId").alias("b"))
    return per_job.agg(F.count("*").alias("n_jobs"), F.sum("n").alias("n_events"), F.count_distinct("a").alias("n_ids"), F.count_if(F.col("a") != F.col("b")).alias("split"))


@query("f9_missing_paths", "SELECT path FROM v10 WHERE old_md5 IS NOT NULL AND new_md5 IS NULL")
def _(spark, d):
    old, new = manifests(spark, d)
    return VS.missing_paths(old.select("path"), new.select("path"))


@query("m3_violations", """SELECT 'null_feature' AS "check", count(*) AS n FROM v1 WHERE feature_1 IS NULL OR feature_3 IS NULL""")
def _(spark, d):
    checks = {
        "null_feature": lambda df: df.where("feature_1 IS NULL OR feature_3 IS NULL"),
        "bad_target": lambda df: df.where("target NOT IN (0, 1)"),
    }
    return VS.violations(v1(spark, d), checks)


@query("j18_file_manifest")
def _(spark, d):
    path = SRC.write_table(table(spark, d, "orders"), scratch_dir(spark, "hashed"), "csv")
    return VS.file_manifest(spark, path).select("md5", "size")
