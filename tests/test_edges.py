"""Small hand-written tables for the edges of each meaning."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alerts, clean, drift, evaluation, labels, lineage, logs, ml, registry, reports, tseries, versions
from tidemark.sources import reports as report_files
from tidemark.sources import tables

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def series(spark, values, step=60):
    return spark.createDataFrame([("a", at(i * step), float(v)) for i, v in enumerate(values)], "s string, ts timestamp_ntz, value double")


def test_report_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"ArtifactName": "a:1", "CreatedAt": "2024-01-01T00:00:00Z", "Results": [\n {"Vulnerabilities": [{"VulnerabilityID": "C-1", "FixedVersion": "%s"}]}]}' % ("9" * 80))
    (tmp_path / "nothing.json").write_text('{"ArtifactName": "b:1", "Results": [{"Vulnerabilities": null}]}')
    (tmp_path / "null.json").write_text('{"ArtifactName": "c:1", "Results": null}')
    (tmp_path / "noname.json").write_text('{"CreatedAt": "not a time", "Results": [{"Vulnerabilities": [{"VulnerabilityID": "C-2", "Severity": "LOW"}]}]}')
    (tmp_path / "cut.json").write_text('{"ArtifactName": "y", "Resul')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.txt").write_text("{}")
    good, broken = report_files.read_reports(spark, str(tmp_path))
    assert reports.images_scanned(good).first()["images_scanned"] == 4
    assert [r["file"].split("/")[-1] for r in broken.collect()] == ["cut.json"]
    found = {r["vulnerability_id"]: r for r in reports.findings(good).collect()}
    assert set(found) == {"C-1", "C-2"}
    assert found["C-1"]["severity"] == "UNKNOWN" and found["C-2"]["image"] == "unknown"
    fixed = {r["vulnerability_id"]: r["fixed_version"] for r in reports.vuln_details(reports.findings(good)).collect()}
    assert len(fixed["C-1"]) == 64
    assert {r["image"]: r["last_scan"] for r in reports.last_scan(good).collect()} == {"a:1": 1704067200.0}


def test_fresh_file_waits(spark, tmp_path):
    (tmp_path / "fresh.json").write_text('{"ArtifactName": "a", "Results": []}')
    assert report_files.read_reports(spark, str(tmp_path), settle_seconds=3600)[0].count() == 0
    assert report_files.read_reports(spark, str(tmp_path))[0].count() == 1


def test_missing_table_is_a_clear_error(spark, tmp_path):
    with pytest.raises(tables.MissingDataError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        ml.load_model(str(tmp_path / "model"))


def test_counter_reset(spark):
    out = tseries.increase(series(spark, [5, 9, 2, 4]), ["s"], 180).collect()
    assert max((r["ts"], r["increase"]) for r in out)[1] == 8.0
    grid = tseries.increase_grid(series(spark, [5, 9, 2, 4]), ["s"], 60, 180).collect()
    assert {r["at"]: r["value"] for r in grid}[at(180)] == 8.0


def test_one_sample_gives_no_growth(spark):
    assert tseries.increase(series(spark, [5]), ["s"], 180).count() == 0
    assert tseries.increase_grid(series(spark, [5]), ["s"], 60, 180).count() == 0


BUCKETS = [(0.1, 850.0), (0.5, 980.0), (1.0, 992.0), (math.inf, 1000.0)]


@pytest.mark.parametrize("q,want", [(0.99, 0.5 + 0.5 * 10 / 12), (0.999, 1.0), (0.5, 0.1 * 500 / 850)])
def test_bucket_quantile(spark, q, want):
    rows = spark.createDataFrame([("a", le, c) for le, c in BUCKETS], "s string, le double, c double")
    assert tseries.histogram_quantile(rows, q, ["s"]).first()["value"] == pytest.approx(want)


def test_infinite_bucket_from_text(spark):
    rows = spark.createDataFrame([("a", "0.5", 5.0), ("a", "+Inf", 10.0)], "s string, le string, c double")
    assert tseries.histogram_quantile(rows, 0.9, ["s"]).first()["value"] == 0.5


def test_missing_label_is_empty(spark):
    df = spark.createDataFrame([({"a": "x"},), ({"container": "c"},)], "labels map<string,string>")
    assert labels.match_labels(df, ne={"container": ""}).count() == 1
    assert labels.match_labels(df, eq={"container": ""}).count() == 1
    assert labels.match_labels(df, re={"container": ""}).count() == 1


def test_regex_is_anchored(spark):
    df = spark.createDataFrame([({"a": "abc"},)], "labels map<string,string>")
    assert labels.match_labels(df, re={"a": "b"}).count() == 0
    assert labels.match_labels(df, re={"a": "a|abc"}).count() == 1


def test_replace_without_match_keeps_the_row(spark):
    df = spark.createDataFrame([({"a": "x", "t": "old"},)], "labels map<string,string>")
    assert labels.replace(df, "t", ["a"], "(y.*)").first()["labels"]["t"] == "old"
    assert labels.replace(df, "t", ["a"], "(x.*)", "<$1>").first()["labels"]["t"] == "<x>"


def test_labelmap_last_source_wins(spark):
    df = spark.createDataFrame([({"m_a": "1", "n_a": "2", "a": "0"},)], "labels map<string,string>")
    assert labels.labelmap(df, "[mn]_(.+)").first()["labels"] == {"m_a": "1", "n_a": "2", "a": "2"}


def test_app_fallback(spark):
    df = spark.createDataFrame([({"ns": "x"},), ({"ns": "x", "name": "n"},)], "labels map<string,string>")
    out = labels.fallback_label(df, "app", ["app", "name", "container"], F.concat(F.lit("unknown-"), labels.label(df, "ns")))
    assert [r["labels"]["app"] for r in out.collect()] == ["unknown-x", "n"]


def test_gate_at_equality(spark):
    rows = spark.createDataFrame([(0.75, 0.70), (0.7499, 0.9), (None, 0.9)], "accuracy double, f1 double")
    assert [r["passed_gates"] for r in evaluation.quality_gate(rows).collect()] == [True, False, None]
    assert [r["next_step"] for r in evaluation.gate_branch(rows).collect()][2] == "skip_registration"


def test_drift_threshold_is_strict(spark):
    rows = spark.createDataFrame([(True, 0.1), (True, 0.1000001), (True, None), (False, 0.9)], "has_report boolean, drift_share double")
    assert [r["status"] for r in drift.drift_status(rows).collect()] == ["healthy", "drift_detected", "healthy", "no_report"]


def test_no_summary_no_retraining(spark):
    datasets = spark.createDataFrame([("a",), ("b",)], "dataset string")
    shares = spark.createDataFrame([("a", 0.5)], "dataset string, drift_share double")
    assert {r["dataset"]: r["retrain"] for r in drift.retrain_decision(datasets, shares).collect()} == {"a": True, "b": False}


def test_same_data_never_drifts(spark):
    df = spark.createDataFrame([(float(i % 7), str(i % 3)) for i in range(50)], "n double, c string")
    rows = drift.drift_report(df, df).collect()
    assert not any(r["drifted"] for r in rows) and {r["drift_share"] for r in rows} == {0.0}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x"] for r in ml.standard_scale(df, ["x"]).collect()] == [0.0, 0.0]


def test_unseen_category_is_all_zero(spark):
    fitted = ml.fit_one_hot(spark.createDataFrame([("a",), ("b",)], "c string"), ["c"])
    row = ml.apply_one_hot(spark.createDataFrame([("z",)], "c string"), fitted).first()
    assert row.asDict() == {"c_a": 0.0, "c_b": 0.0}


def test_too_many_categories_are_refused(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        ml.fit_one_hot(df, ["c"], limit=10)


def test_versions_compare_as_numbers(spark):
    rows = spark.createDataFrame([("m", "9", "None", 0.9, 0.9), ("m", "10", "Staging", 0.9, 0.9), ("m", "3", "Production", 0.9, 0.9)],
                                 "model string, version string, stage string, accuracy double, f1 double")
    assert registry.latest_version(rows).first()["version"] == "10"
    once = registry.promote(rows)
    stages = {r["version"]: r["stage"] for r in once.collect()}
    assert stages == {"9": "None", "10": "Production", "3": "Archived"}


def test_failed_gate_changes_nothing(spark):
    rows = spark.createDataFrame([("m", "2", "None", 0.1, 0.9), ("m", "1", "Production", 0.9, 0.9)],
                                 "model string, version string, stage string, accuracy double, f1 double")
    assert {r["version"]: r["stage"] for r in registry.promote(rows).collect()} == {"2": "None", "1": "Production"}


def test_alert_needs_the_whole_hold(spark):
    evals = spark.createDataFrame([("a", at(s), on) for s, on in [(0, True), (299, True), (300, False), (600, True), (900, True), (930, True)]],
                                  "s string, at timestamp_ntz, active boolean")
    states = {r["at"]: r["state"] for r in alerts.alert_states(evals, ["s"], "active", 300).collect()}
    assert [states[at(s)] for s in (0, 299, 300, 600, 900, 930)] == ["pending", "pending", "inactive", "pending", "firing", "firing"]


def test_no_predictions_yet(spark):
    empty = spark.createDataFrame([], "failed boolean, ms double")
    assert evaluation.request_stats(empty, F.col("failed"), "ms").first().asDict() == {"predictions": 0, "errors": 0, "avg_latency_ms": 0.0}


def test_image_list(spark):
    df = spark.createDataFrame([("a:1  b:2 a:1 sha256:ff",), ("  ",)], "images string")
    targets = reports.scan_targets(df, "images")
    assert reports.scan_target_counts(targets).first().asDict() == {"scanned": 2, "skipped": 1}


def test_column_names(spark):
    out, renames = clean.normalise_columns(spark.createDataFrame([(1,)], ["` x`".strip("`")]).toDF(" Feature 1 "))
    assert out.columns == ["feature_1"] and renames == [(" Feature 1 ", "feature_1")]
    with pytest.raises(ValueError):
        clean.normalise_columns(spark.createDataFrame([(1, 2)], ["A", " a"]))


def test_nan_rows_are_dropped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert clean.drop_null_rows(df).count() == 1
    assert clean.dropped_row_count(df).first().asDict() == {"before": 3, "kept": 1, "dropped": 2}


def test_log_lines(spark):
    lines = spark.createDataFrame([("2024-01-01T00:00:00.5Z stdout F hello there",), ("nonsense",), ("2024-99-01T00:00:00Z stderr P x",), (None,)], "value string")
    good, bad = logs.parse_cri(lines)
    assert good.first()["line"] == "hello there" and good.first()["ts"] == datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert bad.count() == 3


def test_duplicate_match_is_an_error(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "k string, value double")
    b = spark.createDataFrame([("x", 4.0)], "k string, value double")
    with pytest.raises(Exception, match="one-to-one"):
        tseries.vector_div(a, b, ["k"]).collect()


def test_zero_denominator_is_filtered(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "k string, value double")
    b = spark.createDataFrame([("x", 0.0), ("y", 4.0)], "k string, value double")
    assert [(r["k"], r["value"]) for r in tseries.vector_div(a, b, ["k"]).collect()] == [("y", 0.25)]


def test_safe_filename(spark):
    df = spark.createDataFrame([("reg/a:1@x y",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(S.safe_filename(F.col("s"))).collect()] == ["reg_a_1_xy", "unknown_image", "unknown_image"]


def test_cycle_in_lineage_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {r["node"]: r["depth"] for r in lineage.lineage_downstream(edges, ["a"]).collect()} == {"b": 1, "c": 2}


def test_missing_paths_block_publication(spark):
    need, have = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string")
    with pytest.raises(ValueError, match="b"):
        versions.require_paths(need, have)
    versions.require_paths(have, need)


def test_run_rows_round_trip(spark):
    run = registry.run_row(spark, "r1", "base", {"trees": 100}, {"accuracy": 0.4}, ["x"])
    assert registry.compare_runs(run, ["accuracy", "f1"]).first().asDict() == {"run_id": "r1", "accuracy": 0.4, "f1": None}


def test_describe_treats_nan_as_missing_and_keeps_infinity(spark):
    from tidemark.operators import stats

    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (2.0,)], "x double")
    row = stats.describe(df, ["x"]).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (3, 1.0, 2.0, math.inf)
    rough = stats.describe(df, ["x"], exact=False).first()
    assert rough["q50"] == 2.0


def test_order_statistics_of_empty_and_missing_columns(spark):
    empty = spark.createDataFrame([], "x double, y long")
    assert [(r["statistic"], r["drifted"]) for r in drift.drift_report(empty, empty).collect()] == [(None, False)] * 2
    some = spark.createDataFrame([(None, 3), (None, None), (None, 1)], "x double, y long")
    assert [(r["row_id"], r["y"]) for r in clean.add_row_id(some, "y").collect()] == [(0, None), (1, 1), (2, 3)]
    scored = spark.createDataFrame([(1, None), (0, 0.5), (1, 0.5), (1, 0.9)], "y int, s double")
    assert evaluation.roc_auc(scored, "y", "s").first()[0] == pytest.approx(0.75)


def test_no_infinite_bucket_no_quantile(spark):
    rows = spark.createDataFrame([("a", 0.5, 5.0), ("a", 1.0, 10.0)], "s string, le double, c double")
    assert tseries.histogram_quantile(rows, 0.9, ["s"]).first()["value"] is None


@pytest.mark.parametrize("as_map", [False, True])
def test_counters_of_two_methods_are_two_series(spark, as_map):
    """Neither grows by 0.05 a second, and the jumps between them are no restarts."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=15 * i + 7 * m), 1000.0 * m + i // 20, method) for i in range(80) for m, method in enumerate(("get", "put"))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double, method string").withColumn("metric", F.lit("http_requests_total"))
    if as_map:
        pairs = [F.lit("method"), F.col("method"), F.lit("namespace"), F.lit("n"), F.lit("status"), F.lit("500")]
        df = df.select("metric", "ts", "value", F.create_map(*pairs).alias("labels"))
    else:
        df = df.withColumns({"namespace": F.lit("n"), "status": F.lit("500")})
    assert alerts.evaluate_rule(alerts.RULES["HighErrorRate"], df).count() == 0


def test_a_column_that_vanishes_has_drifted(spark):
    ref = spark.createDataFrame([(float(i), "a", 1.0, None) for i in range(50)], "x double, t string, y double, z double")
    cur = spark.createDataFrame([(None, None, 1.0, None) for _ in range(50)], "x double, t string, y double, z double")
    rows = {r["column"]: r for r in drift.drift_report(ref, cur).collect()}
    assert {c: r["drifted"] for c, r in rows.items()} == {"x": True, "t": True, "y": False, "z": False}
    assert rows["x"]["statistic"] is None and rows["x"]["drift_share"] == 0.5


def test_profile_of_large_offsets_and_nan(spark):
    from tidemark.operators import stats

    rows = [(1e9, 0, True), (1e9 + 1, 1, None), (float("nan"), 0, False)]
    df = spark.createDataFrame(rows, "x double, part int, b boolean")
    whole = {r["column"]: r for r in stats.profile_summary(stats.profile(df, sketches=False)).collect()}
    parts = {r["column"]: r for r in stats.profile_summary(stats.merge_profiles(stats.profile(df, ["x"], by=["part"], sketches=False))).collect()}
    for r in (whole["x"], parts["x"]):
        assert r["std"] == pytest.approx(0.5) and r["nulls"] == 1 and r["mean"] == 1e9 + 0.5
    assert whole["b"]["nulls"] == 1
    assert {r["column"]: r["nulls"] for r in stats.null_counts(df).collect()} == {"x": 1, "b": 1}


def test_classes_outside_the_list_stay(spark):
    from tidemark.operators import evaluation

    df = spark.createDataFrame([(0, 2), (2, 2), (0, 0)], "y int, pred int")
    rows = {r["actual"]: r for r in evaluation.confusion_matrix(df, "y", "pred", [0, 1]).collect()}
    assert rows[0]["pred_2"] == 1 and rows[2]["pred_2"] == 1 and rows[1]["pred_1"] == 0


def test_unlisted_severities_are_counted(spark):
    from tidemark.operators import reports

    df = spark.createDataFrame([("i", "LOW", 1), ("i", "NEW", 2), ("i", None, 4)], "image string, severity string, n long")
    row = reports.to_matrix(df, "image", "severity", "n", ["LOW"]).first()
    assert (row["LOW"], row["other"]) == (1, 6)


@pytest.mark.parametrize("x,k,want", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 5, 1.0)])
def test_chi_squared_tail_at_any_size(x, k, want):
    from tidemark.functions.special import upper_gamma

    assert upper_gamma(k / 2, x / 2) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("k", [2_001, 50_000, 1_000_000])
def test_chi_squared_tail_of_many_degrees_is_near_its_normal_limit(k):
    from tidemark.functions.special import upper_gamma

    for z in (-2.0, 0.0, 1.5):
        x = k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3
        assert upper_gamma(k / 2, x / 2) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_missing_run_ids_are_made(spark):
    from tidemark.operators import lineage

    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(None, "a", t, t, ["i"], ["o"]), (None, "b", t, t, ["i"], ["o"]), ("r", "c", t, t, ["i"], ["o"])],
                                 "run_id string, job string, started timestamp_ntz, ended timestamp_ntz, inputs array<string>, outputs array<string>")
    by_job = {}
    for r in lineage.lineage_events(jobs).collect():
        by_job.setdefault(r["job"]["name"], set()).add(r["run"]["runId"])
    assert all(len(v) == 1 and None not in v for v in by_job.values())
    assert len(set.union(*by_job.values())) == 3 and by_job["c"] == {"r"}


def test_a_cycle_forgets_what_is_gone(spark, tmp_path):
    from tidemark.streaming import runs

    out = str(tmp_path / "cycle")
    assert runs.publish_cycle(spark.range(3), out) == 0
    assert runs.publish_cycle(spark.range(1), out) == 1
    assert runs.read_latest(spark, out).count() == 1


def test_grids_take_any_ratio(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 1, 1, 10), 2.0)], "s string, ts timestamp_ntz, value double")
    grid = tseries.eval_grid(rows, ["s"], 1, 36_000)
    last = grid.orderBy(F.col("at").desc()).first()
    assert (grid.count(), last["n"], last["total"]) == (36_001, 2, 3.0)


def test_equal_times_give_one_whole_row(spark):
    from tidemark.operators import features

    rows = spark.createDataFrame([(1, T0, 1.0, 9.0), (1, T0, 2.0, 3.0), (1, T0, 2.0, None)], "e int, ts timestamp_ntz, a double, b double")
    assert features.materialize_latest(rows, "e", "ts", ["a", "b"]).first()[2:] == (2.0, 3.0)
    spine = spark.createDataFrame([(1, T0), (1, at(7200))], "e int, at timestamp_ntz")
    got = features.point_in_time(spine, rows, "e", "at", "ts", ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in got] == [(2.0, 3.0)] * 2
