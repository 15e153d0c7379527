"""Queries: label matching and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import table, v4, v4map, v5, v7, v7map
from tidemark.functions.scalars import first_filled
from tidemark.operators import clean, labels as L, tseries as TS


def shown(df, *names, key="target_id"):
    """Chosen labels as columns, missing ones empty."""
    return df.select(key, *[L.label(df, n).alias(n.strip("_")) for n in names])


@query("b9_match_labels", "SELECT instance, kind, ts, value FROM v4 WHERE kind <> 'view' AND instance <> '' AND regexp_full_match(instance, 'u1.*')")
def _(spark, d):
    df = L.match_labels(v4map(spark, d), ne={"kind": "view"}, re={"instance": "u1.*"})
    return df.select(L.label(df, "instance").alias("instance"), L.label(df, "kind").alias("kind"), "ts", "value")


@query("b9_match_missing_label", "SELECT count(*) AS n_missing_equal_empty, 0::BIGINT AS n_missing_filled FROM v4")
def _(spark, d):
    df = v4map(spark, d)
    flag = L.label(df, "container")
    return df.agg(F.count_if(flag == "").alias("n_missing_equal_empty"), F.count_if(flag != "").alias("n_missing_filled"))


@query("b9_match_promoted", "SELECT namespace, app, ts FROM v5 WHERE namespace = 'ns-3' AND app IN ('error', 'view')")
def _(spark, d):
    return L.match_labels(v5(spark, d), eq={"namespace": "ns-3"}, re={"app": "error|view"}).select("namespace", "app", "ts")


@query("b12_threshold_filter", "SELECT instance, kind, ts, value FROM v4 WHERE value > 100")
def _(spark, d):
    return TS.threshold_filter(v4(spark, d), ">", 100).drop("metric")


@query("b13_time_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN timestamp '2024-01-09 12:00:00' AND timestamp '2024-01-10 12:00:00'")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return TS.time_range(e, "2024-01-09 12:00:00", "2024-01-10 12:00:00")


@query("b20_null_as_zero", "SELECT coalesce(sum(CASE WHEN regexp_matches(line, '(?i)(warn|warning)') THEN 1 END), 0)::BIGINT AS warnings FROM v5")
def _(spark, d):
    from tidemark.operators.logs import WARNING, line_filter

    hits = line_filter(v5(spark, d), WARNING).agg(F.sum(F.lit(1)).alias("n"))
    return hits.select(clean.null_as_zero(F.col("n")).cast("long").alias("warnings"))


@query("c1_keep", "SELECT target_id, meta_pod AS meta_pod FROM v7 WHERE meta_scrape = 'true' AND regexp_full_match(concat(meta_namespace, ';', meta_scrape), 'ns-1\\d*;true')")
def _(spark, d):
    df = L.keep(L.keep(v7map(spark, d), ["__meta_scrape"], "true"), ["__meta_namespace", "__meta_scrape"], r"ns-1\d*;true")
    return shown(df, "__meta_pod")


@query("c2_drop", "SELECT target_id FROM v7 WHERE meta_container <> ''")
def _(spark, d):
    return L.drop(v7map(spark, d), ["__meta_container"], "").select("target_id")


@query(
    "c1_c2_partition",
    "SELECT count(*) FILTER (WHERE regexp_full_match(meta_namespace, 'ns-[12].*')) AS kept, count(*) FILTER (WHERE NOT regexp_full_match(meta_namespace, 'ns-[12].*')) AS dropped FROM v7",
)
def _(spark, d):
    df = v7map(spark, d)
    kept = L.keep(df, ["__meta_namespace"], "ns-[12].*").agg(F.count("*").alias("kept"))
    dropped = L.drop(df, ["__meta_namespace"], "ns-[12].*").agg(F.count("*").alias("dropped"))
    return kept.select("kept", dropped.scalar().alias("dropped"))


@query("c3_replace", "SELECT target_id, concat(meta_namespace, '/', meta_pod) AS job, CASE WHEN target_id % 3 = 0 THEN '' ELSE concat('seg-', meta_label_app) END AS segment FROM v7")
def _(spark, d):
    df = L.replace(v7map(spark, d), "job", ["__meta_namespace", "__meta_pod"], sep="/")
    df = L.replace(df, "segment", ["__meta_label_app"], "(.+)", "seg-$1")
    return shown(df, "job", "segment")


@query(
    "c4_labelmap",
    "SELECT target_id, meta_label_app AS app, meta_label_name AS name, meta_label_app AS meta_label_app FROM v7",
)
def _(spark, d):
    return shown(L.labelmap(v7map(spark, d), "__meta_label_(.+)"), "app", "name", "__meta_label_app")


@query("c5_labeldrop", "SELECT target_id, '' AS meta_pod, meta_namespace FROM v7")
def _(spark, d):
    return shown(L.labeldrop(v7map(spark, d), ["__meta_pod", "__meta_port"]), "__meta_pod", "__meta_namespace")


@query("c6_metric_keep", "SELECT kind, count(*) AS n FROM (SELECT concat('container_', kind) AS metric, kind FROM v4) WHERE regexp_full_match(metric, 'container_(error|view|fs).*') GROUP BY 1")
def _(spark, d):
    named = v4(spark, d).withColumn("metric", F.concat(F.lit("container_"), F.col("kind")))
    return L.metric_keep(named, "container_(error|view|fs).*").groupBy("kind").agg(F.count("*").alias("n"))


FALLBACK_SQL = """CASE WHEN meta_label_app <> '' THEN meta_label_app WHEN meta_label_name <> '' THEN meta_label_name
    WHEN meta_container <> '' THEN meta_container ELSE concat('unknown-', meta_namespace) END"""


@query("c7_fallback_label", f"SELECT target_id, {FALLBACK_SQL} AS app FROM v7")
def _(spark, d):
    df = v7map(spark, d)
    last = F.concat(F.lit("unknown-"), L.label(df, "__meta_namespace"))
    return shown(L.fallback_label(df, "app", ["__meta_label_app", "__meta_label_name", "__meta_container"], last), "app")


@query("c7_fallback_columns", f"SELECT target_id, {FALLBACK_SQL} AS app FROM v7")
def _(spark, d):
    app = first_filled(F.col("meta_label_app"), F.col("meta_label_name"), F.col("meta_container"))
    return v7(spark, d).select("target_id", F.coalesce(app, F.concat(F.lit("unknown-"), F.col("meta_namespace"))).alias("app"))


@query("c8_external_labels", "SELECT instance, 'test' AS cluster, kind, ts FROM v4")
def _(spark, d):
    df = L.external_labels(v4map(spark, d), {"cluster": "test", "kind": "ignored"})
    return df.select(*[L.label(df, n).alias(n) for n in ("instance", "cluster", "kind")], "ts")


@query(
    "c9_limit_labels",
    "SELECT target_id, (meta_label_app <> '')::INT + (meta_label_name <> '')::INT + (meta_container <> '')::INT + 5 <= 6 AS accepted FROM v7",
)
def _(spark, d):
    good, rejected = L.limit_labels(v7map(spark, d), 6)
    return good.select("target_id", F.lit(True).alias("accepted")).unionAll(rejected.select("target_id", F.lit(False).alias("accepted")))


@query("c10_rewrite_port", "SELECT target_id, regexp_replace(concat(address, ';', meta_port), '^([^:]+)(?::\\d+)?;(\\d+)$', '\\1:\\2') AS address FROM v7")
def _(spark, d):
    return v7(spark, d).select("target_id", L.rewrite_port(F.col("address"), F.col("meta_port")).alias("address"))


# fixed values: the rewriting steps of the pod log job, in order
POD_LOG_RULES = [
    {"action": "labelmap", "regex": "__meta_label_(.+)"},
    {"source": ["app", "__meta_label_name"], "regex": ";(.+)", "target": "app"},
    {"source": ["app", "__meta_container"], "regex": ";(.+)", "target": "app"},
    {"source": ["app", "__meta_namespace"], "regex": ";(.+)", "target": "app", "replacement": "unknown-$1"},
    {"source": ["__meta_namespace", "__meta_pod"], "sep": "/", "target": "job"},
    {"source": ["__meta_namespace"], "target": "namespace"},
    {"source": ["__meta_pod"], "target": "pod"},
    {"source": ["__meta_container"], "target": "container"},
    {"source": ["__address", "__meta_port"], "regex": r"([^:]+)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target": "__address"},
    {"action": "labeldrop", "names": ["name"]},
    {"action": "keep", "source": ["app"], "regex": ".+"},
]


@query(
    "c_relabel_pod_logs",
    f"""SELECT target_id, {FALLBACK_SQL} AS app, concat(meta_namespace, '/', meta_pod) AS job, meta_namespace AS namespace, meta_pod AS pod,
       meta_container AS container, '' AS name, regexp_replace(address, ':80$', ':9090') AS address FROM v7""",
)
def _(spark, d):
    df = L.relabel(v7map(spark, d), POD_LOG_RULES)
    return shown(df, "app", "job", "namespace", "pod", "container", "name", "__address")


@query("d25_label_values", "SELECT DISTINCT pod FROM v5 WHERE regexp_full_match(namespace, 'ns-[13]') AND app <> ''")
def _(spark, d):
    return L.label_values(L.match_labels(v5(spark, d), ne={"app": ""}, re={"namespace": "ns-[13]"}), "pod")
