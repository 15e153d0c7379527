"""Alert states batch by batch against a walk over each series."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.streaming import jobs as J
from tidemark.streaming import runs as R

START = datetime(2024, 1, 1)
SCHEMA = "name string, at timestamp_ntz, on boolean"


def run(spark, folder, batches, **how):
    """One run of the stream for each batch; the states of all evaluations and the size of the state after each."""
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = R.read_stream(spark, f"{folder}/in", SCHEMA)
        J.alert_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", "name", "on", **how)
        newest = spark.read.parquet(f"{folder}/state")
        sizes.append(newest.where(newest.version == newest.agg({"version": "max"}).first()[0]).count())
    return sorted(map(str, spark.read.parquet(f"{folder}/out").drop("batch").collect())), sizes


def brute(batches, hold, idle=None):
    held, out, sizes = {}, [], []
    for rows in batches:
        newest = max((last for _, last in held.values()), default=None)
        late = [r for r in rows if (r[0] in held and r[1] <= held[r[0]][1]) or (idle and newest and r[1] < newest - timedelta(seconds=idle))]
        out += [(name, at, None, "late") for name, at, _ in late]
        for name, at, on in sorted((r for r in rows if r not in late), key=lambda r: (r[1], bool(r[2]))):
            since = held.get(name, (None, None))[0]
            since = (since or at) if on else None
            held[name] = (since, at)
            out.append((name, at, since, "inactive" if not on else "firing" if (at - since).total_seconds() >= hold else "pending"))
        if idle:
            newest = max(last for _, last in held.values())
            held = {k: v for k, v in held.items() if v[1] >= newest - timedelta(seconds=idle)}
        sizes.append(len(held))
    return sorted(f"Row(name={n!r}, at={a!r}, since={s!r}, state={t!r})" for n, a, s, t in out), sizes


def batches():
    rng = random.Random(11)
    made = []
    for b in range(4):
        rows = []
        for name, n in (("busy", 400), ("all on", 60), ("some", 25), (None, 9)):
            share = 1.0 if name == "all on" else 0.93
            for _ in range(n):
                at = START + timedelta(minutes=1000 * b + rng.randrange(-40 if b else 0, 1000))
                rows.append((name, at, rng.choice([False, None]) if rng.random() > share else True))
        if b == 0:
            rows.append(("gone", START, True))
        if b == 3:
            rows += [("gone", START + timedelta(minutes=3500), True), ("gone", START + timedelta(minutes=3), True)]
        made.append(list(dict.fromkeys(rows)))
    return made


@pytest.mark.parametrize("how", [{}, {"rows": 7, "block": 3600}, {"rows": 7, "idle": 70_000}])
def test_equals_a_walk(spark, tmp_path, how):
    """Blocks of seven rows spread each series; with an idle limit the series that is gone leaves the state."""
    want, sizes = brute(batches(), 1800, how.get("idle"))
    assert run(spark, tmp_path, batches(), hold=1800, **how) == (want, sizes)
    assert sizes == ([5, 4, 4, 5] if "idle" in how else [5, 5, 5, 5])
    assert any("late" in w for w in want) and any("firing" in w for w in want)


def test_empty_batch(spark, tmp_path):
    rows = [("a", START, True), ("a", START + timedelta(hours=1), True)]
    assert run(spark, tmp_path, [[], rows, []], idle=60)[1][1:] == [1, 1]
