"""Linked calls against a walk of each conversation in Python."""

import json
import random

from tidemark.llm import chat

SCHEMAS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "sum": {"values": ("array", True), "scale": ("number", False)}, "ping": {}}
CALLS = "conv_id long, turn int, call_id string, name string, arguments string, after array<string>, level string"
RESULTS = "conv_id long, turn int, call_id string, output string, position string"


def canonical(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def kind_ok(v, kind):
    return {"string": isinstance(v, str), "integer": isinstance(v, int) and not isinstance(v, bool), "number": isinstance(v, (int, float)) and not isinstance(v, bool), "array": isinstance(v, list)}[kind]


def brute(calls, results):
    ids, outs = {}, {}
    for conv, turn, cid, name, args, after in calls:
        if conv is not None and cid is not None:
            ids.setdefault((conv, cid), []).append((turn, (args is None, args or ""), name, args, after))
    for conv, turn, cid, out in results:
        outs.setdefault((conv, cid), []).append((turn, (out is None, out or ""), out))
    chosen = {k: min(v, key=lambda x: x[:2]) for k, v in ids.items()}
    level = {}
    convs = {c for c, _ in chosen}
    for conv in convs:
        mine = {k[1]: v for k, v in chosen.items() if k[0] == conv}
        deps = {c: {d for d in (v[4] or []) if d in mine} for c, v in mine.items()}
        if all(mine[d][0] < mine[c][0] for c in deps for d in deps[c]):
            level |= {(conv, c): 0 for c in mine}
            continue
        done = {}
        while True:
            new = {c: 1 + max((done[d] for d in deps[c]), default=-1) for c in mine if c not in done and all(d in done for d in deps[c])}
            if not new:
                break
            done |= new
        level |= {(conv, c): done.get(c) for c in mine}
    rows = []
    for conv in convs:
        order = sorted((level[k], v[0], k[1]) for k, v in chosen.items() if k[0] == conv and level[k] is not None)
        at = {c: i for i, (_, _, c) in enumerate(order)}
        for (cv, cid), (turn, _, name, args, after) in chosen.items():
            if cv != conv:
                continue
            found = sorted(outs.get((cv, cid), []), key=lambda x: x[:2])
            value = canonical(args)
            errors = []
            if not isinstance(value, dict):
                errors.append("arguments are no object")
            if name not in SCHEMAS:
                errors.append("unknown tool")
            elif isinstance(value, dict):
                for f, (kind, required) in SCHEMAS[name].items():
                    if f not in value:
                        errors += [f"missing {f}"] * required
                    elif not kind_ok(value[f], kind):
                        errors.append(f"{f} is no {kind}")
                errors += [f"unexpected {k}" for k in value if k not in SCHEMAS[name]]
            errors += ["no result"] * (not found) + ["repeated id"] * (len(ids[cv, cid]) > 1 or len(found) > 1) + ["cycle"] * (level[cv, cid] is None)
            errors += ["unknown dependency"] * any((cv, d) not in chosen for d in after or [])
            body = json.dumps({"arguments": value, "id": cid, "name": name, "result": found[0][2] if found else None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            rows.append((cv, cid, turn, at.get(cid), level[cv, cid], found[0][0] if found else None, len(ids[cv, cid]), len(found), sorted(errors), body))
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ['{"query": "é\\n", "limit": 3}', '{"limit": "x", "query": 5}', '{"z": {"b": 1, "a": [true, null]}, "query": "q"}', '{"values": [1, 2], "scale": 2}', '{"values": "no"}', "{}", "[1]", "not json", "", None]
    calls, results = [], []
    for conv in range(30):
        n = rng.choice([1, 4, 9, 600 if conv == 7 else 5])
        for i in range(n):
            cid = f"c{i}" if rng.random() > 0.05 else f"c{max(0, i - 1)}"
            after = [f"c{rng.randrange(max(1, i))}" for _ in range(rng.choice([0, 1, 2]))] if i else None
            if conv % 3 == 0 and rng.random() < 0.2:
                after = [f"c{rng.randrange(n)}"]  # forwards, itself, cycles
            if rng.random() < 0.05:
                after = ["nowhere", *(after or [])]
            calls.append((conv, 2 * i, cid, rng.choice(["search", "sum", "ping", "other", None]), rng.choice(texts), after))
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                results.append((conv, 2 * i + 1, cid, rng.choice(["ok", "", None, "ü" * 50])))
    results.append((99, 1, "c0", "belongs to none"))
    lost = [(None, 0, "c0", "ping", "{}", None), (1, 0, None, "ping", "{}", None)]
    got = chat.link_calls(spark.createDataFrame([(*c, "x") for c in calls + lost], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), SCHEMAS)
    rows = [(r["conv_id"], r["call_id"], r["turn"], r["position"], r["level"], r["result_turn"], r["n_calls"], r["n_results"], list(r["errors"]), r["json"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, brute(calls, results)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_empty(spark):
    assert chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_long_chain_forwards_in_logarithmic_rounds(spark):
    n = 5000
    calls = [(1, i, f"c{i}", "ping", "{}", [f"c{i + 1}"] if i + 1 < n else None, "x") for i in range(n)]
    got = chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert {r["call_id"]: r["position"] for r in got.collect()} == {f"c{i}": n - 1 - i for i in range(n)}
