"""Scan findings: flattening, counts, details, matrices and display helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tseries import previous_value

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")  # fixed values, in display order
COLOURS = ("red", "orange", "yellow", "green")  # fixed values, same order


def findings(reports: DataFrame) -> DataFrame:
    """One row per finding. Null ``Results`` and ``Vulnerabilities`` mean no findings; missing fields
    get their defaults."""
    flat = (
        reports.select(
            F.coalesce("ArtifactName", F.lit("unknown")).alias("image"),
            F.coalesce("CreatedAt", F.lit("")).alias("scan_time"),
            F.explode("Results").alias("r"),
        )
        .select("image", "scan_time", F.explode("r.Vulnerabilities").alias("v"))
    )
    text = {
        "vulnerability_id": ("VulnerabilityID", ""),
        "package": ("PkgName", ""),
        "installed_version": ("InstalledVersion", ""),
        "fixed_version": ("FixedVersion", ""),
        "severity": ("Severity", "UNKNOWN"),
        "title": ("Title", ""),
    }
    return flat.select("image", "scan_time", *[F.coalesce(f"v.{src}", F.lit(dflt)).alias(n) for n, (src, dflt) in text.items()])


def vuln_counts(found: DataFrame) -> DataFrame:
    """Findings per (image, severity, package), duplicates counted."""
    return found.groupBy("image", "severity", "package").agg(F.count("*").alias("n"))


def vuln_details(found: DataFrame, width: int = 64) -> DataFrame:
    """Distinct findings with the fixed version cut to ``width`` characters."""
    return found.select(
        "vulnerability_id", "image", "package", "severity", "installed_version",
        F.substring("fixed_version", 1, width).alias("fixed_version"),
    ).distinct()


def last_scan(reports: DataFrame) -> DataFrame:
    """Newest scan time per image in epoch seconds; unparsable times are ignored."""
    when = F.unix_micros(F.try_to_timestamp("CreatedAt"))
    return (
        reports.groupBy(F.coalesce("ArtifactName", F.lit("unknown")).alias("image"))
        .agg((F.max(when) / F.lit(1e6)).alias("last_scan"))
        .where(F.col("last_scan").isNotNull())
    )


def images_scanned(reports: DataFrame) -> DataFrame:
    """Valid reports (an image in two reports counts twice) and distinct images."""
    return reports.agg(
        F.count("*").alias("images_scanned"),
        F.count_distinct(F.coalesce("ArtifactName", F.lit("unknown"))).alias("distinct_images"),
    )


def scan_targets(lists: DataFrame, col: str) -> DataFrame:
    """Distinct image references of whitespace-separated lists; digest-only ones are marked skipped."""
    image = F.explode(F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")).alias("image")
    return (
        lists.select(image).where("image <> ''").distinct()
        .withColumn("skipped", F.startswith("image", F.lit("sha256:")))
        .orderBy("image")
    )


def scan_target_counts(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count_if(~F.col("skipped")).alias("scanned"), F.count_if("skipped").alias("skipped"))


def placeholder_reports(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """Every wanted target has a report; a failed scan gives one with no results and no time.

    Found and failed targets are joined apart: in an inner join a much-scanned image can be split over
    tasks, which an outer join on that side does not allow.
    """
    names = ["ArtifactName", "CreatedAt", "Results"]
    wanted = targets.select(F.col("image").alias("ArtifactName")).distinct()
    found = reports.select(*names).join(wanted, "ArtifactName")
    failed = wanted.join(reports.select("ArtifactName").distinct(), "ArtifactName", "left_anti").select(
        "ArtifactName", F.lit(None).cast("string").alias("CreatedAt"), F.array().cast(reports.schema["Results"].dataType).alias("Results")
    )
    return found.select(*names).unionByName(failed).withColumn("Results", F.coalesce("Results", F.array().cast(reports.schema["Results"].dataType)))


def severity_filter(found: DataFrame, levels: str = "HIGH,CRITICAL") -> DataFrame:
    """Keep the severities of a comma-separated list."""
    wanted = [s.strip() for s in levels.split(",") if s.strip()]
    return found.where(F.col("severity").isin(wanted))


def severity_index(severity: Column) -> Column:
    """0 for the most severe level; null for anything unlisted."""
    pairs = [x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]
    return F.element_at(F.create_map(*pairs), severity)


def severity_colour(severity: Column) -> Column:
    pairs = [x for s, c in zip(SEVERITIES, COLOURS) for x in (F.lit(s), F.lit(c))]
    return F.element_at(F.create_map(*pairs), severity)


def advisory_link(finding_id: Column, base: str = "https://nvd.nist.gov/vuln/detail/") -> Column:
    return F.concat(F.lit(base), finding_id)


def sum_by(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("value"))


def avg_by(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("value"))


def max_all(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.max(value).alias("value"))


def reduce(df: DataFrame, value: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Panel reducers: last non-null, max, sum."""
    return df.groupBy(*by).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("last_not_null"),
        F.max(value).alias("max"),
        F.sum(value).alias("sum"),
    )


def to_matrix(df: DataFrame, row: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """One column per listed value, zero where a pair is absent, and ``other`` for all further values and null;
    the values are given, so no extra pass."""
    unlisted = ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.groupBy(row).agg(
        *[F.sum(F.when(F.col(column) == v, F.col(value)).otherwise(0)).alias(v) for v in values],
        F.sum(F.when(unlisted, F.col(value)).otherwise(0)).alias("other"),
    )


def sort_desc(df: DataFrame, value: str, labels: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *labels)


def sort_by_severity(df: DataFrame, descending: bool, ties: Sequence[str] = ()) -> DataFrame:
    """Most severe first by default order of the index; unlisted severities last."""
    key = F.coalesce(severity_index(F.col("severity")), F.lit(len(SEVERITIES)))
    return df.orderBy(key.desc() if descending else key.asc(), *ties)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def counts_over_time(found: DataFrame, ts: str, step: str) -> DataFrame:
    """Findings per severity and time step."""
    return found.groupBy(F.window(ts, step)["start"].alias("window_start"), "severity").agg(F.count("*").alias("n"))


def images_over_time(found: DataFrame, ts: str, step: str) -> DataFrame:
    """Distinct images with a scan per time step."""
    return (
        found.select(F.window(ts, step)["start"].alias("window_start"), "image").distinct()
        .groupBy("window_start").agg(F.count("*").alias("images"))
    )


def level_over_time(found: DataFrame, ts: str, step: str, by: str = "severity") -> DataFrame:
    """The gauge of findings at the end of every time step, from the first scan to the last: ``window_start``, ``by``, ``findings``.

    An image counts with its newest scan so far, however old; a newer scan without a finding of a kind takes it out.
    Every scan adds its counts in its step and takes them off in that of the image's next scan, so that work follows
    the scans, not scans times steps; only the sums per step, for all steps of every kind, are added up in order.
    """
    scans = found.select("image", F.col(ts).cast("timestamp_ntz").alias("_ts"), by)
    counts = scans.groupBy("image", "_ts", by).agg(F.count("*").alias("n"))
    times = scans.select("image", "_ts").distinct().withColumn("_at", F.col("_ts"))
    ends = previous_value(times, ["image"], "_ts", "_at").where(F.col("previous").isNotNull()).select("image", F.col("previous").alias("_ts"), F.col("_ts").alias("_end"))
    gone = counts.join(ends, ["image", "_ts"]).select(F.col("_end").alias("_t"), by, (-F.col("n")).alias("n"))
    moves = counts.select(F.col("_ts").alias("_t"), by, "n").unionByName(gone)
    start = F.window("_t", step)["start"].cast("timestamp_ntz")
    sums = moves.groupBy(start.alias("window_start"), by).agg(F.sum("n").alias("n"))
    # all scans have a step, also those of which the sums are zero
    span = scans.select(F.window("_ts", step)["start"].cast("timestamp_ntz").alias("s")).agg(F.min("s").alias("a"), F.max("s").alias("b"))
    grid = scans.select(by).distinct().withColumns({"_a": span.select("a").scalar(), "_b": span.select("b").scalar()})
    grid = grid.select(by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias("window_start"))
    met = grid.join(sums.withColumnRenamed(by, "_by"), (F.col(by).eqNullSafe(F.col("_by"))) & (grid["window_start"] == sums["window_start"]), "left")
    upto = Window.partitionBy(by).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    return met.select(grid["window_start"], by, F.coalesce("n", F.lit(0)).alias("n")).select("window_start", by, F.sum("n").over(upto).alias("findings"))
