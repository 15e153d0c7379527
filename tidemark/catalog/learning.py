"""Queries: scaling, encoding, splitting, training, scoring and their documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tabular import PER_CLASS, REPORT_SQL, rounded
from tidemark.catalog.views import drift_pair, table, v1, v2
from tidemark.operators import drift, evaluation, ml, stats
from tidemark.plans.scratch import scratch_dir
from tidemark.plans.training import Params, train
from tidemark.schemas import EVALUATION
from tidemark.sources import tables as SRC

NAMES = ("feature_1", "feature_2", "feature_3")
CLEAN_SQL = "c AS (SELECT * FROM v1 WHERE feature_1 IS NOT NULL AND feature_3 IS NOT NULL)"


def cleaned(spark, d):
    return v1(spark, d).na.drop("any")


@query(
    "k1_standard_scale",
    f"""WITH {CLEAN_SQL}, s AS (SELECT avg(feature_1) m1, stddev_pop(feature_1) s1, avg(feature_2) m2, stddev_pop(feature_2) s2 FROM c)
       SELECT row_key, round((feature_1 - m1) / s1, 6) AS feature_1, round((feature_2 - m2) / s2, 6) AS feature_2, feature_3 FROM c, s""",
)
def _(spark, d):
    df = cleaned(spark, d).select("row_key", *NAMES)
    return rounded(ml.standard_scale(df, ["feature_1", "feature_2"]), "feature_1", "feature_2")


@query(
    "k1_standard_scale_train_fit",
    f"""WITH {CLEAN_SQL}, s AS (SELECT avg(feature_1) m1, stddev_pop(feature_1) s1 FROM c
         WHERE ('0x' || substr(md5('42:' || row_key::VARCHAR), 1, 8))::BIGINT % 10000 >= 2000)
       SELECT row_key, round((feature_1 - m1) / s1, 6) AS feature_1 FROM c, s""",
)
def _(spark, d):
    df = cleaned(spark, d).select("row_key", "feature_1")
    return rounded(ml.standard_scale(df, ["feature_1"], ml.train_test_split(df, "row_key")[0]), "feature_1")


@query("k1_no_columns", "SELECT row_key, feature_1 FROM v1")
def _(spark, d):
    return ml.standard_scale(v1(spark, d).select("row_key", "feature_1"), [])


@query(
    "k2_one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + " FROM orders",
)
def _(spark, d):
    return ml.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query(
    "k2_one_hot_vector",
    """WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS slot FROM orders GROUP BY 1)
       SELECT o_orderkey, slot, 1.0::DOUBLE AS total FROM orders JOIN c ON orders.o_orderpriority = c.o_orderpriority""",
)
def _(spark, d):
    out = ml.one_hot_vector(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])
    flags = vector_to_array("o_orderpriority_vector")
    return out.select(
        "o_orderkey", (F.array_position(flags, 1.0) - 1).alias("slot"), F.aggregate(flags, F.lit(0.0), lambda a, x: a + x).alias("total")
    )


SPLIT = "('0x' || substr(md5('42:' || o_orderkey::VARCHAR), 1, 8))::BIGINT"


@query("k3_train_test_split", f"SELECT o_orderkey, {SPLIT} % 10000 < 2000 AS is_test FROM orders")
def _(spark, d):
    train_part, test_part = ml.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return train_part.withColumn("is_test", F.lit(False)).unionAll(test_part.withColumn("is_test", F.lit(True)))


@query(
    "k3_train_test_split_exact",
    f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {SPLIT}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.2)",
)
def _(spark, d):
    return ml.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", exact=True)[1]


def small_forest(spark, d, trees=20):
    train_part, test_part = ml.train_test_split(cleaned(spark, d), "row_key")
    return ml.fit_forest(train_part, NAMES, trees=trees), test_part


@query("k4_fit_forest")
def _(spark, d):
    model, test_part = small_forest(spark, d, 100)
    return evaluation.evaluation_row(ml.score(model, test_part), "target", "prediction")


@query("k5_score")
def _(spark, d):
    model, test_part = small_forest(spark, d)
    return ml.score(model, test_part).select("row_key", "prediction", "probability", "model_name")


@query(
    "k5_score_invariants",
    f"""WITH {CLEAN_SQL} SELECT count(*) AS n, count(*) AS sums_to_one, count(*) AS arg_max FROM c
       WHERE ('0x' || substr(md5('42:' || row_key::VARCHAR), 1, 8))::BIGINT % 10000 < 2000""",
)
def _(spark, d):
    model, test_part = small_forest(spark, d)
    scored = ml.score(model, test_part)
    p = F.col("probability")
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(p[0] + p[1] - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.when(p[1] > p[0], 1).otherwise(0) == F.col("prediction")).alias("arg_max"),
    )


@query("k6_assemble_request", f"SELECT row_key, [feature_1, feature_2, feature_3] AS instances FROM v1")
def _(spark, d):
    return ml.assemble_request(v1(spark, d), NAMES).select("row_key", "instances")


@query("k6_format_response", """SELECT event_id, concat('{"prediction":', pred::VARCHAR, ',"label":"class-', pred::VARCHAR, '"}') AS response FROM v2""")
def _(spark, d):
    return ml.format_response(v2(spark, d).withColumnRenamed("pred", "prediction")).select("event_id", "response")


@query("k7_feature_importance")
def _(spark, d):
    return ml.feature_importance(small_forest(spark, d)[0], spark)


@query("k16_training_run")
def _(spark, d):
    return train(v1(spark, d), Params(numeric=["feature_1"], categorical=["category"], trees=20, fit_on="train")).stages


@query(
    "k16_training_run_counts",
    f"""WITH {CLEAN_SQL}, n AS (SELECT count(*) AS kept, count(*) FILTER (WHERE ('0x' || substr(md5('42:' || row_key::VARCHAR), 1, 8))::BIGINT % 10000 < 2000) AS test FROM c)
       SELECT unnest(['prepare', 'features', 'split', 'train']) AS stage, unnest([kept, kept, test, kept - test]) AS n_rows FROM n""",
)
def _(spark, d):
    stages = train(v1(spark, d), Params(numeric=["feature_1"], categorical=["category"], trees=5, fit_on="train")).stages
    return stages.where("n_rows IS NOT NULL").select("stage", "n_rows")


@query(
    "k17_baseline_support",
    f"""WITH {CLEAN_SQL}, t AS (SELECT target, count(*) AS n FROM c WHERE ('0x' || substr(md5('42:' || row_key::VARCHAR), 1, 8))::BIGINT % 10000 < 2000 GROUP BY 1)
       SELECT target::VARCHAR AS label, n AS support FROM t UNION ALL SELECT l, (SELECT sum(n)::BIGINT FROM t) FROM (VALUES ('macro avg'), ('weighted avg'), ('accuracy')) x(l)""",
)
def _(spark, d):
    return ml.baseline(v1(spark, d), "target", "row_key", trees=5).select("label", "support")


@query("k17_baseline")
def _(spark, d):
    return ml.baseline(v1(spark, d), "target", "row_key", trees=20)


@query("m2_scoring_hooks")
def _(spark, d):
    model, test_part = small_forest(spark, d)
    before = lambda df: df.withColumn("feature_1", F.col("feature_1") / 2)
    return ml.hooked_score(model, test_part, before, ml.format_response).select("row_key", "response")


@query(
    "m2_scoring_hooks_form",
    f"""WITH {CLEAN_SQL} SELECT count(*) AS n, count(*) AS well_formed FROM c WHERE ('0x' || substr(md5('42:' || row_key::VARCHAR), 1, 8))::BIGINT % 10000 < 2000""",
)
def _(spark, d):
    model, test_part = small_forest(spark, d, 5)
    out = ml.hooked_score(model, test_part, None, ml.format_response)
    fits = F.col("response").rlike(r'^\{"prediction":[01],"label":"class-[01]"\}$')
    return out.agg(F.count("*").alias("n"), F.count_if(fits).alias("well_formed"))


@query("a15_save_load_model", f"WITH {CLEAN_SQL} SELECT count(*) AS n, 0::BIGINT AS changed FROM c")
def _(spark, d):
    model, _ = small_forest(spark, d)
    loaded = ml.load_model(ml.save_model(model, scratch_dir(spark, "model")))
    rows = cleaned(spark, d)
    a = ml.score(model, rows).select("row_key", F.col("prediction").alias("p1"))
    b = ml.score(loaded, rows).select("row_key", F.col("prediction").alias("p2"))
    return a.join(b, "row_key").agg(F.count("*").alias("n"), F.count_if(F.col("p1") != F.col("p2")).alias("changed"))


@query(
    "a11_write_metrics_json",
    f"""WITH {PER_CLASS}, m AS (SELECT round((SELECT avg(CASE WHEN y = pred THEN 1.0::DOUBLE ELSE 0.0 END) FROM v2), 4) AS accuracy, round(sum(f * support) / sum(support), 4) AS f1 FROM pr)
       SELECT accuracy, f1, accuracy >= 0.5 AND f1 >= 0.4 AS passed_gates, 0.5::DOUBLE AS min_accuracy, 0.4::DOUBLE AS min_f1 FROM m""",
)
def _(spark, d):
    row = evaluation.evaluation_row(v2(spark, d), "y", "pred", 0.5, 0.4)
    return spark.read.schema(EVALUATION).json(SRC.write_json_row(row, scratch_dir(spark, "metrics")))


@query(
    "a12_write_drift_summary",
    REPORT_SQL + """ SELECT "column", method, drifted, (SELECT avg(CASE WHEN drifted THEN 1.0::DOUBLE ELSE 0.0 END) FROM r) > 0.1 AS dataset_drift FROM r""",
)
def _(spark, d):
    report = drift.drift_report(*drift_pair(spark, d)).select("column", "method", "drifted", "dataset_drift")
    path = SRC.write_table(report, scratch_dir(spark, "drift"), "json")
    return spark.read.schema(report.schema).json(path)


@query("a13_append_profile", "SELECT profile_ts, 'value' AS \"column\", count(*) AS \"rows\" FROM (SELECT unnest(['20240116_000000', '20240131_000000']) AS profile_ts, value FROM events) GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark, "profiles")
    profile = stats.profile(table(spark, d, "events"), ["value"])
    for moment in ("2024-01-16 00:00:00", "2024-01-31 00:00:00"):
        SRC.append_snapshot(profile, path, moment)
    return spark.read.parquet(path).select(F.col("profile_ts").cast("string"), "column", "rows")
