"""Queries: scan reports and their panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import table, v6, v6reports
from tidemark.operators import clean
from tidemark.operators import reports as R
from tidemark.plans.scratch import scratch_dir
from tidemark.sources.reports import compare_listings, list_files, read_listed, write_reports
from tidemark.sources.tables import union_tables

F6 = "f6 AS (SELECT image, vulnerability_id, package, installed_version, fixed_version, coalesce(severity, 'UNKNOWN') AS severity, scan_time FROM v6)"


def found(spark, d):
    """Findings from nested reports, as the report path produces them."""
    return R.findings(v6reports(spark, d))


def finding_count(results):
    """Findings in one report; null lists count nothing."""
    each = F.transform(results, lambda r: F.coalesce(F.array_size(r["Vulnerabilities"]), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def flat(spark, d):
    """Findings from the flat table, severity filled, for panels over counts."""
    return v6(spark, d).withColumn("severity", F.coalesce("severity", F.lit("UNKNOWN")))


@query(
    "a4_read_reports",
    "SELECT image, count(*) AS reports, count(*) AS findings FROM v6 GROUP BY 1",
)
def _(spark, d):
    from tidemark.sources.reports import read_report_lines

    path = write_reports(v6reports(spark, d), scratch_dir(spark, "reports"))
    good, _broken = read_report_lines(spark, path)
    sizes = finding_count(F.col("Results"))
    return good.groupBy(F.col("ArtifactName").alias("image")).agg(F.count("*").alias("reports"), F.sum(sizes).alias("findings"))


def report_texts(spark, d):
    """A text per supplier: a report of one to four findings, the last one twice, or, by the key, white space, a
    report cut off, or one that arrives late."""
    key, n = F.col("s_suppkey"), F.col("s_suppkey") % 4 + 1
    finding = lambda i: F.struct(F.concat(F.lit("CVE-"), i.cast("string")).alias("VulnerabilityID"), F.lit("pkg").alias("PkgName"), F.lit("LOW").alias("Severity"))
    findings = F.transform(F.concat(F.sequence(F.lit(1).cast("bigint"), n), F.array(n)), finding)
    doc = F.to_json(F.struct(F.concat(F.lit("reg/"), key.cast("string")).alias("ArtifactName"), F.array(F.struct(findings.alias("Vulnerabilities"))).alias("Results")))
    kind = F.element_at(F.array(*map(F.lit, ["blank", "cut", "late", "good", "good", "good"])), (key % 6 + 1).cast("int"))
    text = F.when(kind == "blank", " ").when(kind == "cut", F.substring(doc, 1, 40)).otherwise(doc)
    return table(spark, d, "supplier").select(text.alias("value"), kind.alias("kind"))


def write_each(rows, folder):
    """A text file per row, written by as many tasks as the session runs at a time, several times over.

    Rows are dealt in turn; with no more parts than an input task has rows on average none is left empty, as an empty
    first one would write a file. Tasks move their files into the folder themselves.
    """
    parts = min(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // max(rows.rdd.getNumPartitions(), 1))
    dealt = rows.select("value").repartition(parts) if parts > 1 else rows.select("value")
    moved = dealt.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    moved.option("maxRecordsPerFile", 1).text(folder)


@query(
    "a5_settled_reports",
    """SELECT CASE s_suppkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'broken' WHEN 2 THEN 'growing' ELSE 'read' END AS outcome, count(*) AS files,
              coalesce(sum(s_suppkey % 4 + 2) FILTER (WHERE s_suppkey % 6 > 2), 0)::BIGINT AS findings
       FROM supplier GROUP BY 1""",
)
def _(spark, d):
    """A folder with one report per file, listed twice while further files arrive; what was skipped is read from the log."""
    folder, log = scratch_dir(spark, "reports"), scratch_dir(spark, "skipped")
    texts = report_texts(spark, d)
    write_each(texts.where("kind <> 'late'"), folder)
    before = list_files(spark, folder, "*.txt")
    write_each(texts.where("kind = 'late'"), folder)
    good, skipped = read_listed(spark, folder, compare_listings(before, list_files(spark, folder, "*.txt")), log, "*.txt")
    logged = spark.read.schema(skipped.schema).json(log)
    read = good.select(F.lit("read").alias("outcome"), finding_count(F.col("Results")).cast("bigint").alias("n"))
    return read.unionByName(logged.select(F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("n"))).groupBy("outcome").agg(F.count("*").alias("files"), F.sum("n").alias("findings"))


@query("a18_union_reports", "SELECT image, scan_time, package FROM v6")
def _(spark, d):
    all_rows = v6(spark, d)
    left = all_rows.where("package < 'pkg-3'").select("image", "scan_time", "package")
    right = all_rows.where("package >= 'pkg-3'").select("package", "scan_time", "image")
    return union_tables([left, right])


TARGETS_SQL = """lists AS (SELECT concat(' reg/', c_mktsegment, ':', (c_nationkey % 3)::VARCHAR, '  reg/', c_mktsegment, ':', (c_nationkey % 3)::VARCHAR,
    chr(10), 'sha256:', (c_custkey % 40)::VARCHAR, ' ') AS images FROM customer),
  t AS (SELECT DISTINCT unnest(regexp_split_to_array(trim(regexp_replace(images, '\\s+', ' ', 'g')), ' ')) AS image FROM lists)"""


def image_lists(spark, d):
    name = F.concat(F.lit("reg/"), F.col("c_mktsegment"), F.lit(":"), (F.col("c_nationkey") % 3).cast("string"))
    return table(spark, d, "customer").select(
        F.concat(F.lit(" "), name, F.lit("  "), name, F.lit("\n"), F.lit("sha256:"), (F.col("c_custkey") % 40).cast("string"), F.lit(" ")).alias("images")
    )


@query("b14_scan_targets", f"WITH {TARGETS_SQL} SELECT image, image LIKE 'sha256:%' AS skipped FROM t WHERE image <> ''")
def _(spark, d):
    return R.scan_targets(image_lists(spark, d), "images")


@query(
    "b14_scan_target_counts",
    f"WITH {TARGETS_SQL} SELECT count(*) FILTER (WHERE image NOT LIKE 'sha256:%') AS scanned, count(*) FILTER (WHERE image LIKE 'sha256:%') AS skipped FROM t WHERE image <> ''",
)
def _(spark, d):
    return R.scan_target_counts(R.scan_targets(image_lists(spark, d), "images"))


@query(
    "b15_placeholder_reports",
    """SELECT concat('img-', s_suppkey::VARCHAR) AS image, CASE WHEN l_suppkey IS NULL THEN 0 ELSE 1 END::BIGINT AS findings
       FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_suppkey % 3 <> 0) ON s_suppkey = l_suppkey""",
)
def _(spark, d):
    targets = table(spark, d, "supplier").select(F.concat(F.lit("img-"), F.col("s_suppkey").cast("string")).alias("image"))
    number = F.substring("ArtifactName", 5, 20).cast("long")
    done = v6reports(spark, d).where(number % 3 != 0)
    sizes = finding_count(F.col("Results"))
    return R.placeholder_reports(targets, done).select(F.col("ArtifactName").alias("image"), sizes.cast("long").alias("findings"))


@query("b18_map_severity", "SELECT severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 END AS idx, "
       "CASE severity WHEN 'CRITICAL' THEN 'red' WHEN 'HIGH' THEN 'orange' WHEN 'MEDIUM' THEN 'yellow' WHEN 'LOW' THEN 'green' END AS colour, count(*) AS n FROM v6 GROUP BY severity")
def _(spark, d):
    level = F.col("severity")
    counted = v6(spark, d).groupBy("severity").agg(F.count("*").alias("n"))
    return counted.withColumns({"idx": R.severity_index(level), "colour": R.severity_colour(level)})


@query("b19_advisory_link", "SELECT DISTINCT vulnerability_id, concat('https://nvd.nist.gov/vuln/detail/', vulnerability_id) AS link FROM v6")
def _(spark, d):
    return v6(spark, d).select("vulnerability_id").distinct().withColumn("link", R.advisory_link(F.col("vulnerability_id")))


@query("b21_severity_filter", f"WITH {F6} SELECT image, vulnerability_id, severity FROM f6 WHERE severity IN ('HIGH', 'CRITICAL')")
def _(spark, d):
    return R.severity_filter(found(spark, d)).select("image", "vulnerability_id", "severity")


@query("d15_vuln_counts", f"WITH {F6} SELECT image, severity, package, count(*) AS n FROM f6 GROUP BY 1, 2, 3")
def _(spark, d):
    return R.vuln_counts(found(spark, d))


@query("d16_vuln_details", f"WITH {F6} SELECT DISTINCT vulnerability_id, image, package, severity, installed_version, substr(fixed_version, 1, 64) AS fixed_version FROM f6")
def _(spark, d):
    return R.vuln_details(found(spark, d))


@query("d17_last_scan", "SELECT image, epoch_us(max(scan_time)) / 1e6 AS last_scan FROM v6 GROUP BY 1")
def _(spark, d):
    return R.last_scan(v6reports(spark, d))


@query("d18_images_scanned", "SELECT count(*) AS images_scanned, count(DISTINCT l_suppkey) AS distinct_images FROM lineitem")
def _(spark, d):
    return R.images_scanned(v6reports(spark, d))


@query("d19_sum_by", f"WITH {F6} SELECT severity, count(*) AS value FROM f6 GROUP BY 1")
def _(spark, d):
    return R.sum_by(R.vuln_counts(flat(spark, d)), "n", ["severity"])


@query("d19_sum", f"WITH {F6} SELECT count(*) AS value FROM f6")
def _(spark, d):
    return R.sum_by(R.vuln_counts(flat(spark, d)), "n")


@query("d19_sum_critical", "SELECT count(*) AS value FROM v6 WHERE severity = 'CRITICAL'")
def _(spark, d):
    return R.sum_by(R.vuln_counts(flat(spark, d).where("severity = 'CRITICAL'")), "n")


@query("d21_max_scan_millis", "SELECT epoch_us(max(scan_time)) / 1e6 * 1000 AS value FROM v6")
def _(spark, d):
    scans = R.last_scan(v6reports(spark, d)).withColumn("last_scan", F.col("last_scan") * 1000)
    return R.max_all(scans, "last_scan")


@query(
    "d22_reduce",
    "SELECT event_type, arg_max(value, ts) AS last_not_null, max(value) AS \"max\", round(sum(value), 4) AS \"sum\" FROM "
    "(SELECT event_type, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return R.reduce(e, "value", "ts", ["event_type"]).withColumn("sum", F.round("sum", 4))


@query(
    "d23_to_matrix",
    """SELECT image, count(*) FILTER (WHERE severity = 'CRITICAL') AS "CRITICAL", count(*) FILTER (WHERE severity = 'HIGH') AS "HIGH",
       count(*) FILTER (WHERE severity = 'MEDIUM') AS "MEDIUM", count(*) FILTER (WHERE severity = 'LOW') AS "LOW", count(*) FILTER (WHERE coalesce(severity, 'UNKNOWN') = 'UNKNOWN') AS "UNKNOWN", 0::BIGINT AS other FROM v6 GROUP BY 1""",
)
def _(spark, d):
    counted = flat(spark, d).groupBy("image", "severity").agg(F.count("*").alias("n"))
    return R.to_matrix(counted, "image", "severity", "n", [*R.SEVERITIES, "UNKNOWN"])


@query("d24_row_count_footer", f"WITH {F6} SELECT count(*) AS n_rows FROM (SELECT DISTINCT image, severity, package FROM f6)")
def _(spark, d):
    return R.row_count(R.vuln_counts(flat(spark, d)))


@query("d25_label_values_image", "SELECT DISTINCT image FROM v6 WHERE severity = 'HIGH'")
def _(spark, d):
    from tidemark.operators.labels import label_values

    return label_values(flat(spark, d).where("severity = 'HIGH'"), "image")


@query("h2_sort_desc", f"WITH {F6} SELECT image, severity, package, count(*) AS n FROM f6 GROUP BY 1, 2, 3")
def _(spark, d):
    return R.sort_desc(R.vuln_counts(flat(spark, d)), "n", ["image", "severity", "package"])


@query("h3_sort_by_severity", f"WITH {F6} SELECT image, severity, package, count(*) AS n FROM f6 GROUP BY 1, 2, 3")
def _(spark, d):
    return R.sort_by_severity(R.vuln_counts(flat(spark, d)), False, ["image", "package"])


@query("h3_sort_by_severity_desc", f"WITH {F6} SELECT DISTINCT vulnerability_id, severity FROM f6")
def _(spark, d):
    return R.sort_by_severity(flat(spark, d).select("vulnerability_id", "severity").distinct(), True, ["vulnerability_id"])


@query("e12_counts_over_time", f"WITH {F6} SELECT date_trunc('day', scan_time) AS window_start, severity, count(*) AS n FROM f6 GROUP BY 1, 2")
def _(spark, d):
    return R.counts_over_time(flat(spark, d), "scan_time", "1 day")


@query(
    "e12_level_over_time",
    f"""WITH {F6}, n AS (SELECT image, scan_time, lead(scan_time) OVER (PARTITION BY image ORDER BY scan_time) AS ended FROM (SELECT DISTINCT image, scan_time FROM f6)),
        c AS (SELECT image, scan_time, severity, count(*) AS n FROM f6 GROUP BY 1, 2, 3),
        g AS (SELECT unnest(generate_series(min(date_trunc('day', scan_time)), max(date_trunc('day', scan_time)), INTERVAL 1 DAY))::TIMESTAMP AS window_start FROM f6),
        k AS (SELECT window_start, severity FROM g, (SELECT DISTINCT severity FROM f6)),
        s AS (SELECT c.severity, c.n, date_trunc('day', c.scan_time)::TIMESTAMP AS since, date_trunc('day', ended)::TIMESTAMP AS until FROM c JOIN n USING (image, scan_time))
        SELECT k.window_start, k.severity, coalesce(sum(s.n), 0)::BIGINT AS findings
        FROM k LEFT JOIN s ON s.severity = k.severity AND s.since <= k.window_start AND (s.until IS NULL OR s.until > k.window_start) GROUP BY 1, 2""",
)
def _(spark, d):
    return R.level_over_time(flat(spark, d), "scan_time", "1 day")


@query("e12_images_over_time", "SELECT date_trunc('day', scan_time) AS window_start, count(DISTINCT image) AS images FROM v6 GROUP BY 1")
def _(spark, d):
    return R.images_over_time(v6(spark, d), "scan_time", "1 day")


@query(
    "b16_finding_table",
    f"""WITH {F6} SELECT vulnerability_id AS "CVE ID", image AS "Image", package AS "Package", severity AS "Severity",
       installed_version AS "Installed", fixed_version AS "Fixed" FROM (SELECT DISTINCT vulnerability_id, image, package, severity, installed_version, fixed_version FROM f6)""",
)
def _(spark, d):
    return clean.organize(
        R.vuln_details(flat(spark, d)),
        rename={"vulnerability_id": "CVE ID", "image": "Image", "package": "Package", "severity": "Severity",
                "installed_version": "Installed", "fixed_version": "Fixed"},
    )
