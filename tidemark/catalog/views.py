"""Bindings of the input shapes to the test tables: a DataFrame form and the SQL form for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import REPORT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v1(spark: SparkSession, d: str) -> DataFrame:
    """Tabular dataset with nulls and a category."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_key"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("feature_1"),
        F.col("c_acctbal").alias("feature_2"),
        F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 97).cast("double")).alias("feature_3"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
    )


def v2(spark: SparkSession, d: str) -> DataFrame:
    """Labelled predictions and scores."""
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("y"),
        F.when(F.col("value") > 30, 1).otherwise(0).alias("pred"),
        F.col("value").alias("score"),
    )


def v3(spark: SparkSession, d: str) -> DataFrame:
    """Feature history per entity."""
    return table(spark, d, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("row_id"),
        F.col("ts").alias("event_timestamp"),
        F.col("value").alias("feature_1"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("feature_2"),
        F.length("props").cast("double").alias("feature_3"),
    )


def v4(spark: SparkSession, d: str) -> DataFrame:
    """Gauge samples with promoted labels."""
    return table(spark, d, "events").select(
        F.lit("demo_value").alias("metric"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instance"),
        F.col("event_type").alias("kind"),
        "ts",
        "value",
    )


def v4map(spark: SparkSession, d: str) -> DataFrame:
    """The same samples in the general form, labels in a map."""
    return v4(spark, d).select(
        "metric", F.create_map(F.lit("instance"), F.col("instance"), F.lit("kind"), F.col("kind")).alias("labels"), "ts", "value"
    )


def v4c(spark: SparkSession, d: str) -> DataFrame:
    """Counter samples: per kind, a count that restarts at every hundredth sample."""
    from tidemark.catalog.counters import position_in_kind

    e = position_in_kind(table(spark, d, "events"))
    return e.select(
        F.lit("demo_total").alias("metric"), F.col("event_type").alias("kind"), "ts",
        (F.col("position") % 100).cast("double").alias("value"),
    )


BOUNDS = (1, 5, 10, 50, 100, 500)  # fixed values


def v4h(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative histogram buckets per kind, in one pass without multiplying rows."""
    e = table(spark, d, "events")
    wide = e.groupBy(F.col("event_type").alias("kind")).agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in BOUNDS], F.count("value").alias("binf"))
    bounds = [*BOUNDS, "inf"]
    return wide.select(
        "kind", F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{b}").alias("c")) for b in bounds]))
    )


def v5(spark: SparkSession, d: str) -> DataFrame:
    """Log lines; each begins with a level word in one of its spellings, some with two of them."""
    level = F.element_at(F.array(*[F.lit(w) for w in ("WARN ", "warning: ", "info ", "ERROR after INFO: ")]), (F.col("event_id") % 4 + 1).cast("int"))
    user = F.col("user_id").cast("string")
    return table(spark, d, "events").select(
        "ts",
        F.concat(F.lit("ns-"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
        F.col("event_type").alias("app"),
        F.concat(F.lit("pod-"), user).alias("pod"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("container"),
        F.concat(level, F.upper("event_type"), F.lit(" user="), user, F.lit(" "), F.col("props")).alias("line"),
    )


def v6(spark: SparkSession, d: str) -> DataFrame:
    """Flattened scan findings."""
    part = F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("img-"), F.col("l_suppkey").cast("string")).alias("image"),
        F.concat(F.lit("CVE-"), part.cast("string")).alias("vulnerability_id"),
        F.concat(F.lit("pkg-"), (part % 50).cast("string")).alias("package"),
        F.col("l_returnflag").alias("installed_version"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("fix-"), F.col("l_linestatus"))).alias("fixed_version"),
        F.when(F.col("l_linenumber") % 5 == 0, "CRITICAL")
        .when(F.col("l_linenumber") % 5 == 1, "HIGH")
        .when(F.col("l_linenumber") % 5 == 2, "MEDIUM")
        .when(F.col("l_linenumber") % 5 == 3, "LOW")
        .alias("severity"),
        F.col("l_shipdate").alias("scan_time"),
    )


def v6reports(spark: SparkSession, d: str) -> DataFrame:
    """Nested reports, one per scan line, so that no report and no group grows with the data. Each has
    a result with the finding and a second result whose finding list is null."""
    f = v6(spark, d)
    finding = F.struct(
        F.col("vulnerability_id").alias("VulnerabilityID"),
        F.col("package").alias("PkgName"),
        F.col("installed_version").alias("InstalledVersion"),
        F.col("fixed_version").alias("FixedVersion"),
        F.col("severity").alias("Severity"),
        F.lit(None).cast("string").alias("Title"),
    )
    none = F.lit(None).cast(REPORT["Results"].dataType.elementType["Vulnerabilities"].dataType)
    return f.select(
        F.col("image").alias("ArtifactName"),
        F.date_format("scan_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("CreatedAt"),
        F.array(F.struct(F.array(finding).alias("Vulnerabilities")), F.struct(none.alias("Vulnerabilities"))).alias("Results"),
    )


def v7(spark: SparkSession, d: str) -> DataFrame:
    """Discovery labels as columns."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("target_id"),
        F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")).alias("meta_namespace"),
        F.concat(F.lit("pod-"), key.cast("string")).alias("meta_pod"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("meta_label_app"),
        F.when(key % 6 == 0, "").otherwise(F.lower("c_mktsegment")).alias("meta_label_name"),
        F.when(key % 12 == 0, "").otherwise(F.concat(F.lit("c"), (key % 7).cast("string"))).alias("meta_container"),
        F.when(key % 4 == 0, "true").otherwise("false").alias("meta_scrape"),
        F.concat(F.lit("10.0.0."), (key % 250).cast("string"), F.lit(":80")).alias("address"),
        F.lit("9090").alias("meta_port"),
    )


def v7map(spark: SparkSession, d: str) -> DataFrame:
    """Discovery labels as a map keyed like the discovery metadata."""
    cols = [c for c in v7(spark, d).columns if c != "target_id"]
    pairs = [x for c in cols for x in (F.lit("__" + c), F.col(c))]
    return v7(spark, d).select("target_id", F.create_map(*pairs).alias("labels"))


def v8(spark: SparkSession, d: str) -> DataFrame:
    """Registry versions with run metrics; versions number the customers of a nation."""
    from tidemark.catalog.counters import version_in_model

    c = version_in_model(table(spark, d, "customer"))
    return c.select(
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("model"),
        F.col("position").cast("string").alias("version"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Production")
        .when(F.col("c_mktsegment") == "BUILDING", "Staging")
        .when(F.col("c_mktsegment") == "MACHINERY", "Archived")
        .otherwise("None")
        .alias("stage"),
        ((F.col("c_custkey") % 101).cast("double") / 100).alias("accuracy"),
        ((F.col("c_custkey") % 89).cast("double") / 88).alias("f1"),
    )


def v9(spark: SparkSession, d: str) -> DataFrame:
    """Lineage edges: a binary tree over parts."""
    p = F.col("p_partkey")
    return table(spark, d, "part").where(p > 0).select(
        F.concat(F.lit("d"), F.floor(p / 2).cast("string")).alias("src"), F.concat(F.lit("d"), p.cast("string")).alias("dst")
    )


def v10(spark: SparkSession, d: str) -> DataFrame:
    """Old and new manifests side by side."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("s"), (key % 50).cast("string")).alias("stage"),
        F.concat(F.lit("p"), key.cast("string")).alias("path"),
        F.when(key % 23 != 0, F.md5(cust.cast("string"))).alias("old_md5"),
        F.when(key % 19 == 0, F.lit(None))
        .when(key % 17 == 0, F.md5((cust + 1).cast("string")))
        .otherwise(F.md5(cust.cast("string")))
        .alias("new_md5"),
    )


def drift_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First half of the event month as reference, the rest as current."""
    e = table(spark, d, "events").select("ts", "value", "user_id", "event_type")
    cutoff = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    cols = ["value", "user_id", "event_type"]
    return e.where(F.col("ts") < cutoff).select(*cols), e.where(F.col("ts") >= cutoff).select(*cols)


VIEW_SQL = {
    "v1": """select o.o_orderkey as row_key, case when o.o_orderkey % 11 = 0 then null else o.o_totalprice end as feature_1,
       c.c_acctbal as feature_2, case when o.o_orderkey % 13 = 0 then null else cast(o.o_orderkey % 97 as double) end as feature_3,
       o.o_orderpriority as category, case when o.o_orderstatus = 'F' then 1 else 0 end as target
from orders o join customer c on o.o_custkey = c.c_custkey""",
    "v2": """select event_id, case when event_type in ('error','view') then 1 else 0 end as y,
       case when value > 30 then 1 else 0 end as pred, value as score from events""",
    "v3": """select user_id as row_id, ts as event_timestamp, value as feature_1,
       cast(regexp_extract(props, '([0-9]+)', 1) as double) as feature_2, cast(length(props) as double) as feature_3
from events where event_type = 'purchase'""",
    "v4": """select 'demo_value' as metric, concat('u', cast(user_id as varchar)) as instance, event_type as kind, ts, value from events""",
    "v4c": """select 'demo_total' as metric, event_type as kind, ts,
       cast((row_number() over (partition by event_type order by ts, event_id)) % 100 as double) as value from events""",
    "v4h": """select e.event_type as kind, b.le, cast(sum(case when e.value <= b.le then 1 else 0 end) as bigint) as c
from events e cross join (select cast(le as double) as le from (values ('1'),('5'),('10'),('50'),('100'),('500'),('inf')) as t(le)) b
group by e.event_type, b.le""",
    "v5": """select ts, concat('ns-', cast(user_id % 5 as varchar)) as namespace, event_type as app, concat('pod-', cast(user_id as varchar)) as pod,
       concat('c', cast(user_id % 3 as varchar)) as container, concat(CASE event_id % 4 WHEN 0 THEN 'WARN ' WHEN 1 THEN 'warning: ' WHEN 2 THEN 'info ' ELSE 'ERROR after INFO: ' END, upper(event_type), ' user=', cast(user_id as varchar), ' ', props) as line
from events""",
    "v6": """select concat('img-', cast(l_suppkey as varchar)) as image, concat('CVE-', cast(l_partkey as varchar)) as vulnerability_id,
       concat('pkg-', cast(l_partkey % 50 as varchar)) as package, l_returnflag as installed_version,
       case when l_linestatus = 'F' then '' else concat('fix-', l_linestatus) end as fixed_version,
       case l_linenumber % 5 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'LOW' else null end as severity,
       l_shipdate as scan_time
from lineitem""",
    "v7": """select c_custkey as target_id, concat('ns-', cast(c_nationkey as varchar)) as meta_namespace, concat('pod-', cast(c_custkey as varchar)) as meta_pod,
       case when c_custkey % 3 = 0 then '' else c_mktsegment end as meta_label_app,
       case when c_custkey % 6 = 0 then '' else lower(c_mktsegment) end as meta_label_name,
       case when c_custkey % 12 = 0 then '' else concat('c', cast(c_custkey % 7 as varchar)) end as meta_container,
       case when c_custkey % 4 = 0 then 'true' else 'false' end as meta_scrape,
       concat('10.0.0.', cast(c_custkey % 250 as varchar), ':80') as address, '9090' as meta_port
from customer""",
    "v8": """select concat('m', cast(c_nationkey as varchar)) as model,
       cast(row_number() over (partition by c_nationkey order by c_custkey) as varchar) as version,
       case c_mktsegment when 'HOUSEHOLD' then 'Production' when 'BUILDING' then 'Staging' when 'MACHINERY' then 'Archived' else 'None' end as stage,
       cast(c_custkey % 101 as double) / 100 as accuracy, cast(c_custkey % 89 as double) / 88 as f1
from customer""",
    "v9": """select concat('d', cast(cast(floor(p_partkey / 2) as bigint) as varchar)) as src, concat('d', cast(p_partkey as varchar)) as dst
from part where p_partkey > 0""",
    "v10": """select concat('s', cast(o_orderkey % 50 as varchar)) as stage, concat('p', cast(o_orderkey as varchar)) as path,
       case when o_orderkey % 23 = 0 then null else md5(cast(o_custkey as varchar)) end as old_md5,
       case when o_orderkey % 19 = 0 then null when o_orderkey % 17 = 0 then md5(cast(o_custkey + 1 as varchar)) else md5(cast(o_custkey as varchar)) end as new_md5
from orders""",
}
