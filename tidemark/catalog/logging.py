"""Queries: log parsing, filtering and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import table, v5
from tidemark.operators import logs as G
from tidemark.operators import tseries as TS
from tidemark.plans.scratch import scratch_dir
from tidemark.sources.logs import read_lines
from tidemark.sources.tables import partition_by_period, read_period

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def rendered(spark, d, as_json: bool):
    """Runtime lines as text files; every fiftieth line is broken."""
    e = table(spark, d, "events")
    line = F.concat(F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("props"))
    iso = F.date_format("ts", ISO)
    if as_json:
        text = F.to_json(F.struct(F.concat(line, F.lit("\n")).alias("log"), F.lit("stderr").alias("stream"), iso.alias("time")))
    else:
        text = F.concat(iso, F.lit(" stdout F "), line)
    path = scratch_dir(spark, "lines")
    e.select(F.when(F.col("event_id") % 50 == 0, F.lit("{garbage")).otherwise(text).alias("value")).write.text(path)
    return read_lines(spark, path)


LINE_SQL = """SELECT ts, '{stream}' AS stream, concat(upper(event_type), ' user=', user_id::VARCHAR, ' ', props) AS line{more} FROM events WHERE event_id % 50 <> 0"""


@query("a7_parse_cri", LINE_SQL.format(stream="stdout", more=", 'F' AS flag"))
def _(spark, d):
    return G.parse_cri(rendered(spark, d, False))[0]


@query("a7_parse_cri_rejects", "SELECT '{garbage' AS value FROM events WHERE event_id % 50 = 0")
def _(spark, d):
    return G.parse_cri(rendered(spark, d, False))[1]


@query("a8_parse_docker_json", LINE_SQL.format(stream="stderr", more=""))
def _(spark, d):
    return G.parse_docker_json(rendered(spark, d, True))[0]


@query("a8_parse_docker_rejects", "SELECT count(*) AS n FROM events WHERE event_id % 50 = 0")
def _(spark, d):
    return G.parse_docker_json(rendered(spark, d, True))[1].agg(F.count("*").alias("n"))


@query(
    "a9_path_labels",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('ns-', c_nationkey::VARCHAR) END AS namespace,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('pod-', c_custkey::VARCHAR) END AS pod,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('c-', (c_custkey % 3)::VARCHAR) END AS container FROM customer""",
)
def _(spark, d):
    key = F.col("c_custkey").cast("string")
    ns, pod = F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")), F.concat(F.lit("pod-"), key)
    box = F.concat(F.lit("c-"), (F.col("c_custkey") % 3).cast("string"))
    pods = F.concat(F.lit("/var/log/pods/"), ns, F.lit("_"), pod, F.lit("_uid-"), key, F.lit("/"), box, F.lit("/0.log"))
    links = F.concat(F.lit("/var/log/containers/"), pod, F.lit("_"), ns, F.lit("_"), box, F.lit("-"), F.md5(key), F.lit(".log"))
    path = F.when(F.col("c_custkey") % 5 == 0, "/tmp/x.log").when(F.col("c_custkey") % 2 == 0, pods).otherwise(links)
    return G.path_labels(table(spark, d, "customer").select("c_custkey", path.alias("path")), "path").drop("path")


for _period in ("hour", "week", "month"):

    @query(f"a16_partition_by_{_period}", "SELECT ts, namespace, line FROM v5 WHERE ts >= timestamp '2024-01-10 06:00:00' AND ts < timestamp '2024-01-12 06:00:00'")
    def _(spark, d, period=_period):
        path = partition_by_period(v5(spark, d), scratch_dir(spark, "periods"), period=period)
        return read_period(spark, path, "ts", "2024-01-10 06:00:00", "2024-01-12 06:00:00", period=period).select("ts", "namespace", "line")


@query("a16_partition_by_period", "SELECT ts, namespace, line FROM v5 WHERE ts >= timestamp '2024-01-10 06:00:00' AND ts < timestamp '2024-01-12 06:00:00'")
def _(spark, d):
    path = partition_by_period(v5(spark, d), scratch_dir(spark, "periods"))
    return read_period(spark, path, "ts", "2024-01-10 06:00:00", "2024-01-12 06:00:00").select("ts", "namespace", "line")


@query("b10_line_filter", "SELECT ts, line FROM v5 WHERE regexp_matches(line, '(?i)(error|exception|fatal|panic)')")
def _(spark, d):
    return G.line_filter(v5(spark, d), G.ERROR).select("ts", "line")


@query("b11_log_view", "SELECT ts, app, pod, line FROM v5 WHERE regexp_full_match(namespace, 'ns-[12]') AND app <> '' AND regexp_matches(line, '(?i)user=1') ")
def _(spark, d):
    return G.log_view(v5(spark, d), "USER=1", "ns-[12]", limit=None).select("ts", "app", "pod", "line")


@query("b11_log_view_no_search", "SELECT ts, app, line FROM v5 WHERE namespace = 'ns-4' AND app = 'view'")
def _(spark, d):
    return G.log_view(v5(spark, d), "", "ns-4", "view", limit=None).select("ts", "app", "line")


@query("d26_level_counts", "SELECT count(*) FILTER (WHERE regexp_matches(line, '(?i)(error|exception|fatal|panic)')) AS errors, "
       "count(*) FILTER (WHERE regexp_matches(line, '(?i)(warn|warning)')) AS warnings, count(*) FILTER (WHERE regexp_matches(line, '(?i)info')) AS infos FROM v5")
def _(spark, d):
    return G.level_counts(v5(spark, d))


for _by in ("namespace", "app", "container"):

    @query(f"d28_log_volume_{_by}", f"SELECT {_by}, count(*) AS n FROM v5 WHERE {_by} <> '' GROUP BY 1")
    def _(spark, d, by=_by):
        return G.log_volume(v5(spark, d), by)


@query("e7_count_over_time", "SELECT time_bucket(INTERVAL 6 HOUR, ts, timestamp '1970-01-01') AS window_start, count(*) AS n FROM v5 GROUP BY 1")
def _(spark, d):
    return TS.count_over_time(v5(spark, d), "6 hours")


@query("e7_errors_over_time", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM v5 WHERE regexp_matches(line, '(?i)(error|exception|fatal|panic)') GROUP BY 1")
def _(spark, d):
    return TS.count_over_time(G.line_filter(v5(spark, d), G.ERROR), "1 hour")


@query(
    "e8_log_rate",
    """WITH x AS (SELECT namespace, epoch_us(ts) // 1800000000 AS slot FROM v5), y AS (SELECT namespace, unnest([slot + 1, slot + 2]) AS e FROM x)
       SELECT make_timestamp(e * 1800000000) AS "at", namespace, round(count(*) / 3600.0, 9) AS rate FROM y GROUP BY 1, 2""",
)
def _(spark, d):
    out = TS.sliding_rate(v5(spark, d), 3600, 1800, ["namespace"])
    return out.withColumn("rate", F.round("rate", 9))


@query("e8_log_rate_minute", "SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS \"at\", namespace, round(count(*) / 60.0, 9) AS rate FROM v5 GROUP BY 1, 2")
def _(spark, d):
    out = TS.sliding_rate(v5(spark, d), 60, 60, ["namespace"])
    return out.withColumn("rate", F.round("rate", 9))


@query("h4_newest_first", "SELECT ts, line FROM v5")
def _(spark, d):
    return G.log_view(v5(spark, d)).select("ts", "line")


@query("h6_log_view_limit", "SELECT ts, line FROM v5 ORDER BY ts DESC LIMIT 1000")
def _(spark, d):
    return G.log_view(v5(spark, d), limit=1000).select("ts", "line")
