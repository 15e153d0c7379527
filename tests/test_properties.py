"""Relations that must hold for any input, and the shape of the plans."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.catalog import views
from tidemark.functions.special import chi2_pvalue, ks_pvalue
from tidemark.operators import evaluation, features, labels, logs, ml, stats, tseries
from tidemark.plans import blocks, ordered

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed_samples(spark, n=600, seed=1):
    """Series 'hot' holds most of the rows; gaps of very different length, resets and repeats."""
    rng = random.Random(seed)
    t, rows = {"hot": 0, "cold": 0}, []
    for _ in range(n):
        s = "hot" if rng.random() < 0.9 else "cold"
        t[s] += rng.choice([1, 5, 30, 31, 299, 300, 301, 4000])
        rows.append((s, T0 + timedelta(seconds=t[s]), float(rng.choice([0, 1, 2, 5, 9]))))
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, value double"), rows


def brute_increase(rows, span, end_of, kind="increase"):
    out = {}
    for s in ("hot", "cold"):
        mine = sorted((t, v) for k, t, v in rows if k == s)
        for end in end_of(mine):
            seen = [v for t, v in mine if end - timedelta(seconds=span) <= t <= end]
            if len(seen) >= 2:
                if kind == "changes":
                    out[s, end] = sum(a != b for a, b in zip(seen, seen[1:]))
                else:
                    out[s, end] = sum(b if b < a else b - a for a, b in zip(seen, seen[1:]))
    return out


@pytest.mark.parametrize("block", [300, 900, 100_000])
def test_increase_matches_brute_force_for_any_block(spark, block):
    df, rows = skewed_samples(spark)
    got = {(r["s"], r["ts"]): r["increase"] for r in tseries.increase(df, ["s"], 300, block=block).collect()}
    assert got == brute_increase(rows, 300, lambda m: [t for t, _ in m])


@pytest.mark.parametrize("rows", [7, 60])
@pytest.mark.parametrize("span", [300, 30 * 86_400])
def test_increase_over_ranges_longer_than_blocks(spark, rows, span):
    df, data = skewed_samples(spark)
    want = brute_increase(data, span, lambda m: [t for t, _ in m])
    got = {(r["s"], r["ts"]): r["increase"] for r in tseries.increase(df, ["s"], span, rows=rows).collect()}
    assert got == want
    banded = {(r["s"], r["ts"]): r["changes"] for r in tseries.changes(df, ["s"], span, block=3600, rows=rows).collect()}
    assert banded == brute_increase(data, span, lambda m: [t for t, _ in m], "changes")


def test_blocks_are_cut_by_rows_also_in_a_burst(spark):
    us = [10**9 * i for i in range(50)] + [40 * 10**9 + i for i in range(2000)] + [86_400 * 10**6 * 3]
    df = spark.createDataFrame([(None, u) for u in us] + [("a", 5), (None, 7)], "k string, us long").withColumn("_s", F.struct("k"))
    cutter = blocks.TimeBlocks(df.select("_s", "us"), ["_s"], "us", rows=100)
    placed = cutter.place(df, "us").collect()
    sizes = Counter((r["k"], r["_blk"]) for r in placed)
    assert max(sizes.values()) <= 200 and sum(sizes.values()) == len(us) + 2
    order = sorted((r["us"], r["_blk"]) for r in placed if r["k"] is None)
    assert [b for _, b in order] == sorted(b for _, b in order)
    # times without a row have a block between those of their neighbours
    asked = cutter.place(spark.createDataFrame([(None, u + 3) for u in us], "k string, us long").withColumn("_s", F.struct("k")), "us").collect()
    merged = sorted([(r["us"], r["_blk"]) for r in asked] + order)
    assert [b for _, b in merged] == sorted(b for _, b in merged)


def test_null_labels_and_other_time_types_stay_a_series(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 2, 15), ("x", 1, 1), (None, 400, 3)], "s string, t int, value int").select("s", F.timestamp_seconds("t").alias("ts"), "value")
    got = sorted((r["s"] or "", r["value"], r["increase"]) for r in tseries.increase(df, ["s"], 1000, rows=1).collect())
    assert got == [("", 3, 8.0), ("", 15, 5.0)]
    assert tseries.increase(df, ["s"], 1000).schema["ts"].dataType == df.schema["ts"].dataType
    previous = sorted((r["s"] or "", r["value"], r["previous"]) for r in tseries.previous_value(df, ["s"], rows=1).collect())
    assert previous == [("", 3, 15), ("", 10, None), ("", 15, 10), ("x", 1, None)]


def test_range_operator_moves_two_rows_a_sample(spark):
    df, _ = skewed_samples(spark)
    seen = plan(tseries.increase(df, ["s"], 30 * 86_400))
    assert "RangeFrame" not in seen and "Generate inline" in seen and "CartesianProduct" not in seen and "BroadcastNestedLoopJoin" not in seen


@pytest.mark.parametrize("kind", ["increase", "changes"])
def test_increase_grid_matches_brute_force(spark, kind):
    df, rows = skewed_samples(spark, 300)
    last = max(t for _, t, _ in rows)
    ticks = [T0 + timedelta(seconds=30 * i) for i in range(int((last - T0).total_seconds() // 30) + 1)]
    got = {(r["s"], r["at"]): r["value"] for r in tseries.increase_grid(df, ["s"], 30, 300, kind=kind).collect()}
    assert got == brute_increase(rows, 300, lambda m: ticks, kind)


def test_instant_grid_matches_brute_force(spark):
    df, rows = skewed_samples(spark, 200)
    last = max(t for _, t, _ in rows)
    want = {}
    for i in range(int((last - T0).total_seconds() // 30) + 1):
        end = T0 + timedelta(seconds=30 * i)
        for s in ("hot", "cold"):
            seen = [(t, v) for k, t, v in rows if k == s and end - timedelta(seconds=300) <= t <= end]
            if seen:
                want[s, end] = max(seen)[1]
    got = {(r["s"], r["at"]): r["value"] for r in tseries.instant_grid(df, ["s"], 30, 300).collect()}
    assert got == want


def test_previous_value_crosses_empty_blocks(spark):
    df, rows = skewed_samples(spark)
    got = {(r["s"], r["ts"]): r["previous"] for r in tseries.previous_value(df, ["s"], block=60).collect()}
    for s in ("hot", "cold"):
        mine = sorted((t, v) for k, t, v in rows if k == s)
        assert [got[s, t] for t, _ in mine] == [None] + [v for _, v in mine][:-1]


@pytest.mark.parametrize("block,ttl,rows", [(60, 1e9, None), (3600, 1e9, None), (3600, 500, 4), (1e6, 1e9, 9)])
def test_point_in_time_matches_merge_asof(spark, block, ttl, rows):
    rng = random.Random(3)
    def side(n):
        return [("hot" if rng.random() < 0.8 else rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(0, 50_000))) for _ in range(n)]
    feats = [(e, t, float(i)) for i, (e, t) in enumerate(sorted(set(side(150))))]
    spine = [(i, e, t) for i, (e, t) in enumerate(side(200))]
    got = features.point_in_time(
        spark.createDataFrame(spine, "id int, e string, ts timestamp_ntz"), spark.createDataFrame(feats, "e string, fts timestamp_ntz, x double"),
        "e", "ts", "fts", ["x"], ttl=ttl, block=block, rows=rows,
    ).toPandas().set_index("id")["x"]
    a = pd.DataFrame(spine, columns=["id", "e", "ts"]).sort_values("ts")
    b = pd.DataFrame(feats, columns=["e", "fts", "x"]).sort_values("fts")
    want = pd.merge_asof(a, b, left_on="ts", right_on="fts", by="e", tolerance=pd.Timedelta(seconds=min(ttl, 1e8))).set_index("id")["x"]
    assert got.sort_index().fillna(-1).tolist() == want.sort_index().fillna(-1).tolist()


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], list(range(101)), [5.0] * 60 + list(range(30))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r["prob"]: r["quantile"] for r in ordered.exact_quantiles(df, ["x"], [0, 0.1, 0.25, 0.5, 0.9, 1]).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in (0, 0.1, 0.25, 0.5, 0.9, 1)})


def test_running_sums_do_not_depend_on_blocks(spark):
    df = spark.range(200).select((F.col("id") * 7 % 50).cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    results = []
    for cuts in ([], [10.0], [1.0, 2.0, 30.0, 49.0]):
        blocked = ordered.add_blocks(df, {"v": [float("-inf"), *cuts, float("inf")]})
        results.append(sorted((r["v"], r["n_upto"], r["n_total"]) for r in ordered.running_sums(blocked, ["v"], ["n"], "_blk_v").collect()))
    assert results[0] == results[1] == results[2]


def test_split_is_disjoint_exhaustive_and_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    for exact in (False, True):
        train, test = ml.train_test_split(df, "k", exact=exact)
        a, b = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
        assert not a & b and len(a | b) == 2000
        again = ml.train_test_split(df.repartition(7), "k", exact=exact)[1]
        assert {r[0] for r in again.collect()} == b
    assert len(b) == math.ceil(2000 * 0.2)


def test_keep_and_drop_partition_the_rows(spark):
    df = views.v7map(spark, SF)
    for regex in ("ns-1.*", "", ".*"):
        assert labels.keep(df, ["__meta_namespace"], regex).count() + labels.drop(df, ["__meta_namespace"], regex).count() == df.count()


def test_merged_profiles_equal_the_whole(spark):
    e = views.table(spark, SF, "events").withColumn("part", F.col("event_id") % 3)
    cols = ["value", "user_id"]
    whole = stats.profile_summary(stats.profile(e, cols)).orderBy("column").collect()
    merged = stats.profile_summary(stats.merge_profiles(stats.profile(e, cols, by=["part"]))).orderBy("column").collect()
    for a, b in zip(whole, merged):
        assert (a["rows"], a["nulls"], a["min"], a["max"]) == (b["rows"], b["nulls"], b["min"], b["max"])
        assert a["mean"] == pytest.approx(b["mean"]) and a["cardinality"] == pytest.approx(b["cardinality"], rel=0.05)


def test_confusion_counts_sum_to_n(spark):
    df = views.v2(spark, SF)
    assert evaluation.confusion_counts(df, "y", "pred").agg(F.sum("n")).first()[0] == df.count()


def test_newest_equals_plain_top_rows(spark):
    df = views.v5(spark, SF)
    for n in (1, 37, 10_000_000):
        plain = df.orderBy(F.col("ts").desc()).limit(n).collect()
        assert logs.newest(df, n).collect() == plain


@pytest.mark.parametrize("x,k,want", [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0), (124.34211340400407, 100, 0.05), (200.0, 3, 0.0), (2.705543454095404, 1, 0.1), (31.410432844230918, 20, 0.05)])
def test_chi2_tail(spark, x, k, want):
    df = spark.createDataFrame([(x, k)], "x double, k long")
    assert df.select(chi2_pvalue(F.col("x"), F.col("k"))).first()[0] == pytest.approx(want, abs=1e-9)


def test_chi2_tail_of_many_degrees(spark):
    df = spark.createDataFrame([(5165.6151, 5000), (2100.0, 2000), (2100.0, 2001), (1e9, 10**9)], "x double, k long")
    got = [r[0] for r in df.select(chi2_pvalue(F.col("x"), F.col("k"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-5)
    assert got[1] == pytest.approx(got[2], abs=2e-3)  # both sides of the switch agree
    assert got[3] == pytest.approx(0.5, abs=1e-4)


def test_ks_tail(spark):
    df = spark.createDataFrame([(0.2, 100, 100), (0.0, 10, 10), (1.0, 50, 50)], "d double, n long, m long")
    got = [r[0] for r in df.select(ks_pvalue(F.col("d"), F.col("n"), F.col("m"))).collect()]
    lam = math.sqrt(50) * 0.2
    assert got[0] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 50)))
    assert got[1] == 1.0 and got[2] < 1e-9


def test_filters_and_columns_reach_the_scan(spark):
    df = labels.match_labels(views.table(spark, SF, "events").withColumnRenamed("event_type", "app"), eq={"app": "error"})
    text = plan(tseries.time_range(df, "2024-01-09 00:00:00", "2024-01-10 00:00:00").select("event_id"))
    assert "EqualTo(event_type,error)" in text and "GreaterThanOrEqual(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in text


NO_SINGLE_TASK = ["k8_drift_ks", "d11_roc_auc", "b6_add_row_id", "k3_train_test_split_exact", "e2_increase", "f4_point_in_time", "rule_high_error_rate", "d1_describe"]


@pytest.mark.parametrize("name", NO_SINGLE_TASK)
def test_no_window_over_all_rows_and_no_cross_join(spark, name):
    from __spark_entry__ import queries

    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        # the only unkeyed windows are over the offset table, one row per block
        if "Window [" in line and "], [" in line:
            keys = line.split("], [", 1)[1].split("]", 1)[0]
            assert keys.strip() or "_t_" in line, line


def test_newest_state_is_not_lost_on_replay(spark, tmp_path):
    from tidemark.streaming.jobs import _state_before

    for v in (0, 1, 2):
        spark.createDataFrame([(v,)], "x int").write.parquet(f"{tmp_path}/version={v}")
    assert _state_before(spark, str(tmp_path), 2).first()["x"] == 1
    assert _state_before(spark, str(tmp_path), 0).count() == 0


def test_retraining_follows_the_drift_verdict(spark, tmp_path):
    from tidemark.plans.retraining import retrain_if_drifted, scan_panels
    from tidemark.plans.training import Params

    source = views.v1(spark, SF)
    same = source.select("feature_2")
    assert retrain_if_drifted(same, same, source) is None
    moved = source.select((F.col("feature_2") + 5000).alias("feature_2"))
    result = retrain_if_drifted(same, moved, source, Params(trees=2, numeric=["feature_1"], categorical=["category"]))
    stages = {r["stage"]: r for r in result.stages.collect()}
    assert stages["train"]["n_rows"] + stages["split"]["n_rows"] == stages["prepare"]["n_rows"]
    assert 0 <= stages["evaluate"]["value"] <= 1
    events = spark.read.parquet(f"{result.folder}/lineage").collect()
    assert sorted(r["eventType"] for r in events) == ["COMPLETE", "START"]
    assert events[0]["run"]["runId"] == events[1]["run"]["runId"]
    panels = scan_panels(views.v6reports(spark, SF))
    assert panels["counts"].agg(F.sum("n")).first()[0] == panels["images"].first()["images_scanned"]


def test_deep_graph_is_walked_to_the_end_or_refused(spark):
    from tidemark.operators.lineage import lineage_downstream

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    assert lineage_downstream(chain, ["n0"]).count() == 6
    assert lineage_downstream(chain, ["n0"], max_depth=6).count() == 6
    with pytest.raises(ValueError):
        lineage_downstream(chain, ["n0"], max_depth=3)


def test_lag_sorts_labels_once(spark):
    """Rows sorted for the previous value hold the labels in their key alone, and one time."""
    df = spark.createDataFrame([("a", "b", T0, 1.0), ("a", "b", T0 + timedelta(seconds=5), 3.0), (None, "b", T0, 2.0)], "x string, y string, ts timestamp_ntz, value double")
    got = tseries.previous_value(df, ["x", "y"])
    assert got.columns == ["x", "y", "ts", "value", "previous"]
    assert {(r["x"], r["value"]): r["previous"] for r in got.collect()} == {("a", 1.0): None, ("a", 3.0): 1.0, (None, 2.0): None}
    wide = [n for n in _nodes(got._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert wide and all(o.split("#")[0] not in ("x", "y", "_us") for n in wide for o in _names(n.output()))


def _names(columns):
    return [columns.apply(i).toString() for i in range(columns.size())]


def _nodes(node):
    children = node.children()
    return [node, *[m for i in range(children.size()) for m in _nodes(children.apply(i))]]
