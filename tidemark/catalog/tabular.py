"""Queries: cleaning, statistics, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.views import drift_pair, table, v1, v2, v3, v6, v7
from tidemark.functions import scalars as S
from tidemark.operators import clean, drift, evaluation, stats

V1_COLS = "row_key, feature_1, feature_2, feature_3, category, target"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("b1_drop_null_rows", f"SELECT {V1_COLS} FROM v1 WHERE feature_1 IS NOT NULL AND feature_2 IS NOT NULL AND feature_3 IS NOT NULL")
def _(spark, d):
    return clean.drop_null_rows(v1(spark, d))


@query(
    "b2_dropped_row_count",
    """SELECT count(*) AS "before", count(*) FILTER (WHERE feature_1 IS NOT NULL AND feature_3 IS NOT NULL) AS kept,
       count(*) FILTER (WHERE feature_1 IS NULL OR feature_3 IS NULL) AS dropped FROM v1""",
)
def _(spark, d):
    return clean.dropped_row_count(v1(spark, d))


@query("b3_normalise_columns", f"SELECT {V1_COLS} FROM v1")
def _(spark, d):
    messy = v1(spark, d).toDF("Row Key", " Feature 1", "Feature 2 ", " FEATURE 3 ", "Category", "Target")
    return clean.normalise_columns(messy)[0]


@query("b4_split_xy", "SELECT row_key, feature_1, feature_2, feature_3, category FROM v1")
def _(spark, d):
    return clean.split_xy(v1(spark, d))[0]


@query("b4_split_y", "SELECT target FROM v1")
def _(spark, d):
    return clean.split_xy(v1(spark, d))[1]


@query("b5_select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    return clean.select_numeric(table(spark, d, "orders"))


@query("b6_add_row_id", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    return clean.add_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("b7_stamp_event_time", "SELECT o_orderkey, timestamp '2024-06-01 00:00:00' AS event_timestamp FROM orders")
def _(spark, d):
    return clean.stamp_event_time(table(spark, d, "orders").select("o_orderkey"), "2024-06-01 00:00:00")


@query(
    "b8_feature_view",
    "SELECT row_id, event_timestamp, feature_1, feature_1 / (feature_2 + 1) AS ratio FROM v3",
)
def _(spark, d):
    def ratio(df):
        return df.withColumn("ratio", F.col("feature_1") / (F.col("feature_2") + 1))

    return clean.feature_view(v3(spark, d), ratio, ["row_id", "event_timestamp"], ["feature_1", "ratio"])


@query(
    "b16_organize",
    """SELECT image AS "Image", severity AS "Severity", package AS "Package" FROM v6""",
)
def _(spark, d):
    df = v6(spark, d).drop("vulnerability_id", "installed_version", "fixed_version")
    return clean.organize(df, ["scan_time"], {"image": "Image", "severity": "Severity", "package": "Package"})


@query(
    "b17_band",
    """SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n,
       CASE WHEN count(*) >= 1000 THEN 1000.0::DOUBLE WHEN count(*) >= 100 THEN 100.0::DOUBLE WHEN count(*) >= 0 THEN 0.0::DOUBLE END AS band
       FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    e = table(spark, d, "events")
    daily = e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("band", clean.band(F.col("n"), [0, 100, 1000]))


@query(
    "d1_describe",
    """WITH long AS (SELECT 'value' AS "column", value AS x FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE FROM events)
       SELECT "column", count(x) AS "count", round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS "min", max(x) AS "max",
       round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75
       FROM long GROUP BY 1""",
)
def _(spark, d):
    return rounded(stats.describe(table(spark, d, "events"), ["value", "user_id"]), "mean", "std", "q25", "q50", "q75")


@query(
    "d2_null_counts",
    """SELECT * FROM (SELECT 'feature_1' AS "column", count(*) FILTER (WHERE feature_1 IS NULL) AS nulls FROM v1
       UNION ALL SELECT 'feature_3', count(*) FILTER (WHERE feature_3 IS NULL) FROM v1) WHERE nulls > 0""",
)
def _(spark, d):
    return stats.null_counts(v1(spark, d))


@query("d3_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@query(
    "d4_n_unique",
    """SELECT 'o_orderpriority' AS "column", count(DISTINCT o_orderpriority) AS n_unique FROM orders
       UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
       UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders""",
)
def _(spark, d):
    return stats.n_unique(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


PROFILE_SQL = """WITH long AS (
  SELECT ts, 'value' AS "column", 'double' AS "type", value AS x, value::VARCHAR AS t FROM events
  UNION ALL SELECT ts, 'user_id', 'bigint', user_id::DOUBLE, user_id::VARCHAR FROM events
  UNION ALL SELECT ts, 'event_type', 'string', NULL, event_type FROM events)
"""


@query(
    "d5_profile",
    PROFILE_SQL
    + """SELECT "column", "type", count(*) AS "rows", count(*) FILTER (WHERE t IS NULL) AS nulls, min(x) AS "min", max(x) AS "max",
       round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM long GROUP BY 1, 2""",
)
def _(spark, d):
    p = stats.profile(table(spark, d, "events"), ["value", "user_id", "event_type"], sketches=False)
    return rounded(stats.profile_summary(p), "mean", "std")


@query(
    "d5_profile_histogram",
    """SELECT "column", slot, count(x) AS n FROM (
         SELECT 'value' AS "column", value AS x,
           CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 11 ELSE 1 + floor(value / 50)::INT END AS slot FROM events)
       GROUP BY 1, 2""",
)
def _(spark, d):
    p = stats.profile(table(spark, d, "events"), ["value"], limits={"value": (0.0, 500.0)}, sketches=False)
    return p.select("column", F.posexplode("histogram").alias("slot", "n")).where("n > 0")


@query("d5_profile_sketches")
def _(spark, d):
    p = stats.profile(table(spark, d, "events"), ["value", "user_id", "event_type"])
    return stats.profile_summary(p)


@query(
    "d5_profile_sketch_error",
    """SELECT c AS "column", true AS cardinality_ok, m AS median_ok FROM (VALUES ('value', true), ('user_id', true), ('event_type', NULL)) t(c, m)""",
)
def _(spark, d):
    e = table(spark, d, "events")
    cols = ["value", "user_id", "event_type"]
    rough = stats.profile_summary(stats.profile(e, cols)).select("column", "cardinality", "q50")
    exact = stats.n_unique(e, cols).join(stats.describe(e, ["value", "user_id"]).select("column", F.col("q50").alias("median"), "std"), "column", "left")
    both = rough.join(exact, "column")
    return both.select(
        "column",
        (F.abs(F.col("cardinality") - F.col("n_unique")) <= 0.05 * F.col("n_unique")).alias("cardinality_ok"),
        (F.abs(F.col("q50") - F.col("median")) <= 0.1 * F.col("std")).alias("median_ok"),
    )


@query(
    "d6_merge_profiles",
    PROFILE_SQL
    + """SELECT "column", "type", count(*) AS "rows", count(*) FILTER (WHERE t IS NULL) AS nulls, min(x) AS "min", max(x) AS "max",
       round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM long GROUP BY 1, 2""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = stats.profile(e, ["value", "user_id", "event_type"], by=["day"])
    return rounded(stats.profile_summary(stats.merge_profiles(daily)), "mean", "std").drop("cardinality", "q25", "q50", "q75")


@query(
    "d6_compare_profiles",
    PROFILE_SQL
    + """, sides AS (SELECT *, ts >= timestamp '2024-01-16 00:00:00' AS late FROM long),
       s AS (SELECT "column", count(*) FILTER (WHERE NOT late) AS rows_before, count(*) FILTER (WHERE NOT late AND t IS NULL) AS nulls_before,
         min(x) FILTER (WHERE NOT late) AS min_before, max(x) FILTER (WHERE NOT late) AS max_before, avg(x) FILTER (WHERE NOT late) AS mean_before,
         count(*) FILTER (WHERE late) AS rows_after, count(*) FILTER (WHERE late AND t IS NULL) AS nulls_after,
         min(x) FILTER (WHERE late) AS min_after, max(x) FILTER (WHERE late) AS max_after, avg(x) FILTER (WHERE late) AS mean_after
         FROM sides GROUP BY 1)
       SELECT "column", rows_before, nulls_before, min_before, max_before, round(mean_before, 6) AS mean_before, rows_after, nulls_after,
         min_after, max_after, round(mean_after, 6) AS mean_after, rows_after - rows_before AS rows_change,
         round(mean_after - mean_before, 6) AS mean_change FROM s""",
)
def _(spark, d):
    ref, cur = drift_pair(spark, d)
    cols = ["value", "user_id", "event_type"]
    out = stats.compare_profiles(stats.profile(ref, cols, sketches=False), stats.profile(cur, cols, sketches=False))
    return rounded(out, "mean_before", "mean_after", "mean_change")


# evaluation ---------------------------------------------------------------------------------------

PER_CLASS = """cls AS (SELECT y AS c FROM v2 UNION SELECT pred FROM v2),
  pc AS (SELECT c, (SELECT count(*) FROM v2 WHERE y = c) AS support, (SELECT count(*) FROM v2 WHERE pred = c) AS guessed,
         (SELECT count(*) FROM v2 WHERE pred = c AND y = c) AS hit FROM cls),
  pr AS (SELECT c, support, CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r,
         CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hit / (support + guessed) END AS f FROM pc)"""


@query("d7_accuracy", "SELECT round(avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM v2")
def _(spark, d):
    return evaluation.accuracy(v2(spark, d), "y", "pred")


@query("d8_f1_weighted", f"WITH {PER_CLASS} SELECT round(sum(f * support) / sum(support), 4) AS f1 FROM pr")
def _(spark, d):
    return evaluation.f1_weighted(v2(spark, d), "y", "pred")


@query(
    "d9_confusion_matrix",
    """SELECT y AS actual, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 FROM v2 GROUP BY 1""",
)
def _(spark, d):
    return evaluation.confusion_matrix(v2(spark, d), "y", "pred")


@query(
    "d9_confusion_matrix_three",
    """WITH t AS (SELECT l_linenumber % 2 AS y, l_linenumber % 3 AS pred FROM lineitem),
       c AS (SELECT unnest([0, 1, 2]) AS actual)
       SELECT actual, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1, count(*) FILTER (WHERE pred = 2) AS pred_2
       FROM c LEFT JOIN t ON t.y = c.actual GROUP BY 1""",
)
def _(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).cast("int").alias("y"), (F.col("l_linenumber") % 3).cast("int").alias("pred"))
    return evaluation.confusion_matrix(t, "y", "pred", [0, 1])


@query(
    "d10_classification_report",
    f"""WITH {PER_CLASS}, t AS (SELECT sum(support) AS n FROM pr),
       out AS (
         SELECT c::VARCHAR AS label, p AS "precision", r AS recall, f AS f1, support FROM pr
         UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM pr
         UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM pr
         UNION ALL SELECT 'accuracy', NULL, NULL, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), count(*) FROM v2)
       SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM out""",
)
def _(spark, d):
    return rounded(evaluation.classification_report(v2(spark, d), "y", "pred"), "precision", "recall", "f1")


@query(
    "d11_roc_auc",
    """WITH s AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM v2 GROUP BY 1),
       c AS (SELECT pos, sum(neg) OVER (ORDER BY score) - neg / 2.0 AS below FROM s)
       SELECT round((SELECT sum(pos * below) FROM c)::DOUBLE / ((SELECT sum(pos) FROM s)::DOUBLE * (SELECT sum(neg) FROM s)::DOUBLE), 9) AS roc_auc""",
)
def _(spark, d):
    return rounded(evaluation.roc_auc(v2(spark, d), "y", "score"), "roc_auc", digits=9)


def eval_runs(spark, d):
    from tidemark.catalog.views import v8

    c = v8(spark, d)
    return c.select(
        F.concat_ws("-", "model", "version").alias("run_id"),
        F.when(F.col("version").cast("int") % 9 != 0, F.round("accuracy", 4)).alias("accuracy"),
        F.round("f1", 4).alias("f1"),
    )


RUNS_SQL = """runs AS (SELECT concat(model, '-', version) AS run_id,
  CASE WHEN version::INT % 9 = 0 THEN NULL ELSE round(accuracy, 4) END AS accuracy, round(f1, 4) AS f1 FROM v8)"""


@query(
    "d12_quality_gate",
    f"WITH {RUNS_SQL} SELECT run_id, accuracy, f1, (accuracy >= 0.75 AND f1 >= 0.7) AND accuracy IS NOT NULL AS passed_gates FROM runs WHERE accuracy IS NOT NULL "
    "UNION ALL SELECT run_id, accuracy, f1, NULL FROM runs WHERE accuracy IS NULL",
)
def _(spark, d):
    return evaluation.quality_gate(eval_runs(spark, d))


@query(
    "d13_gate_branch",
    f"WITH {RUNS_SQL} SELECT run_id, accuracy, f1, CASE WHEN accuracy >= 0.70 AND f1 >= 0.65 THEN 'register_model' ELSE 'skip_registration' END AS next_step FROM runs",
)
def _(spark, d):
    return evaluation.gate_branch(eval_runs(spark, d))


@query(
    "d14_request_stats",
    """SELECT count(*) FILTER (WHERE event_type <> 'error') AS predictions, count(*) FILTER (WHERE event_type = 'error') AS errors,
       coalesce(round(avg(value) FILTER (WHERE event_type <> 'error'), 2), 0.0) AS avg_latency_ms FROM events""",
)
def _(spark, d):
    return evaluation.request_stats(table(spark, d, "events"), F.col("event_type") == "error", "value")


@query("h1_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return clean.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 5, ["o_orderkey"])


@query("h5_classes", "SELECT DISTINCT y AS class FROM v2")
def _(spark, d):
    return evaluation.classes(v2(spark, d), "y")


@query(
    "g5_top_k",
    "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 10",
)
def _(spark, d):
    sums = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("total"))
    return rounded(clean.top_k(sums, "total", 10, ["user_id"]), "total", digits=4)


# drift --------------------------------------------------------------------------------------------

SIDES = """e AS (SELECT *, CASE WHEN ts < timestamp '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS side FROM events)"""

KS_SQL = SIDES + """,
  lng AS (SELECT 'value' AS "column", value AS x, side FROM e UNION ALL SELECT 'user_id', user_id::DOUBLE, side FROM e),
  n AS (SELECT "column", count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS nc FROM lng GROUP BY 1),
  dv AS (SELECT "column", x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM lng GROUP BY 1, 2),
  cum AS (SELECT "column", x, sum(a) OVER w AS ca, sum(b) OVER w AS cb, lead(x) OVER w AS nx FROM dv WINDOW w AS (PARTITION BY "column" ORDER BY x)),
  gap AS (SELECT cum."column", x, nx, abs(ca / nr - cb / nc) AS g, nr, nc FROM cum JOIN n ON cum."column" = n."column"),
  ks AS (SELECT "column", max(g) AS dd, sum(g * (nx - x)) AS wd, max(nr)::DOUBLE * max(nc) / (max(nr) + max(nc)) AS en FROM gap GROUP BY 1),
  ksp AS (SELECT "column", dd, wd, greatest(0.0, least(1.0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE * exp(-2.0 * k * k * en * dd * dd)) FROM range(1, 101) t(k)))) AS p FROM ks)"""

CHI_SQL = """
  cc AS (SELECT event_type, count(*) FILTER (WHERE side = 0)::DOUBLE AS a, count(*) FILTER (WHERE side = 1)::DOUBLE AS b FROM e GROUP BY 1),
  ct AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS k FROM cc),
  chi AS (SELECT sum(pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb))) AS x,
          max(k) - 1 AS dof FROM cc, ct),
  chip AS (SELECT x, dof, exp(-x / 2) * (1 + x / 2) AS p FROM chi)"""


@query(
    "f10_reference_vs_current",
    f"""WITH {SIDES} SELECT 'value' AS "column", count(value) FILTER (WHERE side = 0) AS n_ref, count(value) FILTER (WHERE side = 1) AS n_cur,
       round(avg(value) FILTER (WHERE side = 0), 6) AS mean_ref, round(avg(value) FILTER (WHERE side = 1), 6) AS mean_cur FROM e
       UNION ALL SELECT 'user_id', count(user_id) FILTER (WHERE side = 0), count(user_id) FILTER (WHERE side = 1),
       round(avg(user_id) FILTER (WHERE side = 0), 6), round(avg(user_id) FILTER (WHERE side = 1), 6) FROM e
       UNION ALL SELECT 'event_type', count(event_type) FILTER (WHERE side = 0), count(event_type) FILTER (WHERE side = 1), NULL, NULL FROM e""",
)
def _(spark, d):
    return rounded(drift.reference_vs_current(*drift_pair(spark, d)), "mean_ref", "mean_cur")


@query("k8_drift_ks", f'WITH {KS_SQL} SELECT "column", round(dd, 9) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drifted FROM ksp')
def _(spark, d):
    out = drift.drift_ks(*drift_pair(spark, d), ["value", "user_id"])
    return rounded(rounded(out, "statistic", digits=9), "p_value")


@query("k9_drift_wasserstein", f'WITH {KS_SQL} SELECT "column", round(wd, 6) AS distance FROM ks')
def _(spark, d):
    return rounded(drift.drift_wasserstein(*drift_pair(spark, d), ["value", "user_id"]), "distance")


@query(
    "k10_drift_chi2",
    f"""WITH {SIDES}, {CHI_SQL} SELECT 'event_type' AS "column", round(x, 6) AS statistic, dof, round(p, 6) AS p_value, p < 0.05 AS drifted FROM chip""",
)
def _(spark, d):
    return rounded(drift.drift_chi2(*drift_pair(spark, d), ["event_type"]), "statistic", "p_value")


@query(
    "k10_drift_chi2_many",
    """WITH c AS (SELECT o_custkey AS v, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1),
       t AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM c),
       s AS (SELECT sum(pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb))) AS x,
                    count(*) - 1 AS dof FROM c, t)
       SELECT 'o_custkey' AS "column", round(x, 6) AS statistic, dof,
              (pow(x / dof, 1.0 / 3) - (1 - 2.0 / (9 * dof))) / sqrt(2.0 / (9 * dof)) > 1.6448536 AS drifted FROM s""",
)
def _(spark, d):
    """As many categories as customers; the verdict is checked against the cube-root normal limit."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    out = drift.drift_chi2(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"])
    return rounded(out, "statistic").drop("p_value")


REPORT_SQL = f"""WITH {KS_SQL}, {CHI_SQL},
  r AS (SELECT "column", 'ks' AS method, dd AS statistic, p AS p_value, p < 0.05 AS drifted FROM ksp
        UNION ALL SELECT 'event_type', 'chi2', x, p, p < 0.05 FROM chip)"""


@query(
    "k11_drift_report",
    REPORT_SQL
    + """ SELECT "column", method, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, drifted,
       round((SELECT avg(CASE WHEN drifted THEN 1.0::DOUBLE ELSE 0.0 END) FROM r), 6) AS drift_share,
       (SELECT avg(CASE WHEN drifted THEN 1.0::DOUBLE ELSE 0.0 END) FROM r) > 0.1 AS dataset_drift FROM r""",
)
def _(spark, d):
    return rounded(drift.drift_report(*drift_pair(spark, d)), "statistic", "p_value", "drift_share")


@query(
    "k11_drift_report_identity",
    """SELECT c AS "column", m AS method, 0.0::DOUBLE AS statistic, 1.0::DOUBLE AS p_value, false AS drifted, 0.0::DOUBLE AS drift_share, false AS dataset_drift
       FROM (VALUES ('value', 'ks'), ('user_id', 'ks'), ('event_type', 'chi2')) t(c, m)""",
)
def _(spark, d):
    e = table(spark, d, "events").select("value", "user_id", "event_type")
    return rounded(drift.drift_report(e, e), "statistic", "p_value")


@query(
    "d27_drift_share",
    REPORT_SQL
    + """ SELECT round(avg(CASE WHEN drifted THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS drift_share,
       avg(CASE WHEN drifted THEN 1.0::DOUBLE ELSE 0.0 END) > 0.1 AS dataset_drift FROM r""",
)
def _(spark, d):
    report = drift.drift_report(*drift_pair(spark, d)).select("column", "drifted")
    return rounded(drift.drift_share(report), "drift_share")


def drift_history(spark, d):
    """One summary row per (user, day) with a share; every seventh user has no report."""
    e = table(spark, d, "events")
    rows = e.groupBy(F.col("user_id").alias("dataset"), F.to_date("ts").alias("day")).agg(
        F.avg((F.col("value") > 40).cast("double")).alias("share"), F.count("*").alias("n")
    )
    return rows.select(
        "dataset",
        "day",
        (F.col("dataset") % 7 != 0).alias("has_report"),
        F.when((F.col("dataset") % 7 != 0) & (F.col("n") % 5 != 0), F.round("share", 4)).alias("drift_share"),
    )


HISTORY_SQL = """h0 AS (SELECT user_id AS dataset, ts::DATE AS day, avg(CASE WHEN value > 40 THEN 1.0::DOUBLE ELSE 0.0 END) AS share, count(*) AS n FROM events GROUP BY 1, 2),
  h AS (SELECT dataset, day, dataset % 7 <> 0 AS has_report, CASE WHEN dataset % 7 <> 0 AND n % 5 <> 0 THEN round(share, 4) END AS drift_share FROM h0)"""


@query(
    "k12_drift_status",
    f"""WITH {HISTORY_SQL} SELECT dataset, day, has_report, drift_share,
       CASE WHEN NOT has_report THEN 'no_report' WHEN coalesce(drift_share, 0) > 0.1 THEN 'drift_detected' ELSE 'healthy' END AS status,
       CASE WHEN NOT has_report THEN 'There is no report to judge by.'
            ELSE concat('Drifted features: ', format('{{:.1f}}', coalesce(drift_share, 0) * 100), '% (limit 10%). ',
                 CASE WHEN coalesce(drift_share, 0) > 0.1 THEN 'Train again.' ELSE 'The model can stay.' END) END AS explanation
       FROM h""",
)
def _(spark, d):
    # one-decimal text of a share rounded to 4 digits never sits on a rounding tie of binary doubles
    return drift.drift_status(drift_history(spark, d))


@query(
    "k13_retrain_decision",
    f"""WITH {HISTORY_SQL}, last AS (SELECT dataset, max(drift_share) AS drift_share FROM h WHERE has_report GROUP BY 1),
       ds AS (SELECT DISTINCT user_id AS dataset FROM events)
       SELECT ds.dataset, drift_share, coalesce(drift_share, 0) > 0.1 AS retrain FROM ds LEFT JOIN last ON ds.dataset = last.dataset""",
)
def _(spark, d):
    datasets = table(spark, d, "events").select(F.col("user_id").alias("dataset")).distinct()
    reported = drift_history(spark, d).where("has_report").groupBy("dataset").agg(F.max("drift_share").alias("drift_share"))
    return drift.retrain_decision(datasets, reported)


DRIFT_BINS = [1, 5, 10, 20, 50, 100]


WINDOWED_DRIFT_SQL = (
    "WITH bins AS (SELECT unnest([-1, 1, 5, 10, 20, 50, 100]) AS b, unnest([1, 5, 10, 20, 50, 100, 1e18]) AS upper_end),"
    """ base AS (SELECT value FROM events WHERE ts < timestamp '2024-01-02 00:00:00'),
       cur AS (SELECT date_trunc('day', ts) AS window_start, value FROM events WHERE ts >= timestamp '2024-01-02 00:00:00'),
       fb AS (SELECT b, (SELECT count(*) FROM base WHERE value < upper_end) / (SELECT count(*) FROM base) AS f FROM bins),
       fc AS (SELECT window_start, b, count(*) FILTER (WHERE value < upper_end) / count(*) AS f, count(*) AS n FROM cur, bins GROUP BY 1, 2)
       SELECT window_start, max(n) AS n, round(max(abs(fc.f - fb.f)), 6) AS distance, max(abs(fc.f - fb.f)) > 0.1 AS drifted
       FROM fc JOIN fb ON fc.b = fb.b GROUP BY 1"""
)


@query("l4_windowed_drift", WINDOWED_DRIFT_SQL)
def _(spark, d):
    e = table(spark, d, "events")
    first_day = F.col("ts") < F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return rounded(drift.windowed_drift(e, "ts", "1 day", first_day, "value", DRIFT_BINS), "distance")


# scalar functions ---------------------------------------------------------------------------------


@query(
    "j4_safe_filename",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'unknown_image'
       ELSE replace(translate(concat('reg/', lower(c_mktsegment), ':', c_custkey::VARCHAR, ' @x'), '/:@', '___'), ' ', '') END AS filename FROM customer""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    image = F.concat(F.lit("reg/"), F.lower("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string"), F.lit(" @x"))
    image = F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")).otherwise(image)
    return c.select("c_custkey", S.safe_filename(image).alias("filename"))


@query(
    "j6_split_tags",
    """SELECT p_partkey, trim(unnest(string_split(concat(p_brand, ' , ', p_type, ',', p_name), ','))) AS tag FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.col("p_brand"), F.lit(" , "), F.col("p_type"), F.lit(","), F.col("p_name"))
    return p.select("p_partkey", F.explode(S.split_tags(text)).alias("tag"))


@query(
    "j9_format_numbers",
    """SELECT o_orderkey, printf('%.2f', o_totalprice) AS two, format('{:,}', o_custkey * 1000) AS thousands,
       concat(printf('%.1f', (o_custkey % 40) / 40.0 * 100), '%') AS pct FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.format_string("%.2f", "o_totalprice").alias("two"),
        F.format_number(F.col("o_custkey") * 1000, 0).alias("thousands"),
        S.percent((F.col("o_custkey") % 40) / 40, 1).alias("pct"),
    )


@query(
    "j10_iso_epoch",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(epoch_us(ts) / 1e6, 6) END AS epoch FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    iso = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("event_id", F.round(S.epoch_seconds(iso), 6).alias("epoch"))


@query(
    "j11_snapshot_name",
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS snapshot FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.snapshot_name(F.col("ts")).alias("snapshot"))


@query(
    "j14_json_number",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE (props->>'$.k')::DOUBLE END AS k FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 5 == 0, F.lit('{"other": 1}')).otherwise(F.col("props"))
    return e.select("event_id", S.json_number(doc, "$.k", 0.0).alias("k"))


@query(
    "j18_table_fingerprint",
    """SELECT count(*) AS n_rows, sum(('0x' || substr(md5(to_json([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_totalprice::VARCHAR, o_orderdate::VARCHAR, o_orderpriority])::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM orders""",
)
def _(spark, d):
    from tidemark.operators.versions import table_fingerprint

    return table_fingerprint(table(spark, d, "orders"))
