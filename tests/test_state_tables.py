"""State tables of streams over many batches."""

import datetime as dt
import os

from tidemark.streaming import jobs


def test_versions_stay_few_and_the_last_is_whole(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{(7 * i) % 5}", t0 + dt.timedelta(minutes=i), float(i)) for i in range(40)]
    source, schema = str(tmp_path / "in"), "user string, ts timestamp_ntz, x double"
    for k in range(0, 40, 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    out = str(tmp_path / "latest")
    jobs.incremental_materialize(stream, out, str(tmp_path / "c1"), "user", "ts", ["x"])
    versions = sorted(int(n.split("=")[1]) for n in os.listdir(out) if n.startswith("version="))
    assert versions == [7, 8, 9]
    newest = {r["user"]: r["x"] for r in spark.read.parquet(f"{out}/version=9").collect()}
    assert newest == {u: x for u, _, x in rows}

    deltas, state = str(tmp_path / "deltas"), str(tmp_path / "state")
    jobs.counter_delta_stream(stream, deltas, state, str(tmp_path / "c2"), ["user"], "ts", "x")
    assert len([n for n in os.listdir(state) if n.startswith("version=")]) == 3
    want, last = [], {}
    for u, _, x in rows:
        want.append((u, x, x - last.get(u, x)))
        last[u] = x
    assert sorted((r["user"], r["x"], r["delta"]) for r in spark.read.parquet(deltas).collect()) == sorted(want)
