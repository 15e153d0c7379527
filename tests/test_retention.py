"""Expiry of day folders, and the lineage of runs that end and that fail."""

import datetime as dt
import os

import pytest

from tests.conftest import SF
from tidemark.catalog import views
from tidemark.plans.training import Params, train
from tidemark.streaming import jobs


def files(folder):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_kept_days_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    t0 = dt.datetime(2024, 3, 1)
    rows = [(i, t0 + dt.timedelta(hours=5 * i)) for i in range(48)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    df.selectExpr("id", "ts", "date_format(ts, 'yyyy-MM-dd') AS dt").write.partitionBy("dt").parquet(path)
    before = files(path)
    begin = dt.datetime(2024, 3, 6, 12)
    done = jobs.drop_expired(spark, path, "ts", "2024-03-11 12:00:00", 120)
    assert done == {"dropped": 5, "rewritten": 1}
    after = files(path)
    later = {f for f in before if f.split("dt=")[1][:10] > "2024-03-06"}
    assert later and {f: before[f] for f in later} == {f: after[f] for f in after if f.split("dt=")[1][:10] > "2024-03-06"}
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "ts").collect()) == [r for r in rows if r[1] >= begin]
    assert not [n for n in os.listdir(path) if n.startswith(("_new", "_old"))]
    # a second time there is nothing left to drop, and at midnight nothing to write again
    assert jobs.drop_expired(spark, path, "ts", "2024-03-11 00:00:00", 96) == {"dropped": 1, "rewritten": 0}


def test_start_is_written_before_the_run_and_stays_alone_if_it_fails(spark, tmp_path):
    source = views.v1(spark, SF)
    folder = str(tmp_path / "good")
    train(source, Params(trees=2, numeric=["feature_1"], categorical=["category"]), folder, "r1")
    events = {r["eventType"]: r for r in spark.read.parquet(f"{folder}/lineage").collect()}
    assert set(events) == {"START", "COMPLETE"} and events["START"]["eventTime"] < events["COMPLETE"]["eventTime"]
    assert events["COMPLETE"]["outputs"][0]["facets"]["rowCount"] > 0 and events["START"]["outputs"][0]["facets"] is None
    folder = str(tmp_path / "bad")
    with pytest.raises(Exception):
        train(source, Params(trees=2, numeric=["no_such_column"]), folder, "r2")
    assert [(r["eventType"], r["run"]["runId"]) for r in spark.read.parquet(f"{folder}/lineage").collect()] == [("START", "r2")]
