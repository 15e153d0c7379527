"""Compiled label rules against applying them one after another in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as L

NAMES = ["app", "pod", "meta_app", "meta_pod", "meta_meta_app", "job"]
VALUES = ["a", "b-1", "", "a;b", "x.y", "ns-3"]


def apply(labels, rules):
    """The labels after the rules, or None where the row goes; empty labels are missing."""
    labels = {k: v for k, v in labels.items() if v}
    for rule in rules:
        action = rule.get("action", "replace")
        text = rule.get("sep", ";").join(labels.get(s, "") for s in rule.get("source", ()))
        hit = re.fullmatch(rule.get("regex", "(.*)"), text, re.DOTALL)
        java = re.sub(r"\$(\d)", r"\\g<\1>", rule.get("replacement", "$1"))
        if action in ("keep", "drop"):
            if bool(hit) != (action == "keep"):
                return None
        elif action == "replace" and hit:
            labels[rule["target"]] = hit.expand(java)
        elif action == "labelmap":
            found = [(m.expand(java), labels[n]) for n in sorted(labels) if (m := re.fullmatch(rule["regex"], n))]
            labels |= dict(found)
        elif action == "labeldrop":
            labels = {k: v for k, v in labels.items() if k not in rule["names"]}
        labels = {k: v for k, v in labels.items() if v}
    return labels


def random_rules(rng, renames=True):
    rules = []
    for _ in range(rng.randrange(1, 8)):
        source = rng.sample(NAMES, rng.choice([1, 1, 2]))
        rules.append(rng.choice([
            {"action": "keep", "source": source, "regex": rng.choice([".*", "a|b-1|", ".+|", ".*[a-z].*|;?"])},
            {"action": "drop", "source": source, "regex": rng.choice(["a", "ns-3|x", "b.1", ";"])},
            {"source": source, "target": rng.choice(NAMES), "sep": rng.choice([";", "/"])},
            {"source": source, "target": rng.choice(NAMES), "regex": rng.choice([";(.+)", "(.)(.*)", "a", "b-1|a", ""]), "replacement": rng.choice(["$1", "v-$1", "fixed", ""]) },
            {"source": source, "target": rng.choice(NAMES), "regex": "(.+)", "replacement": "got-$1"},
            {"action": "labelmap", "regex": "meta_(.+)"} if renames else {"target": "job", "replacement": "x"},
            {"action": "labelmap", "regex": "(m).*_(p.*)", "replacement": "$2_$1"} if renames else {"target": "job"},
            {"action": "labeldrop", "names": rng.sample(NAMES, 2)},
        ]))
    # a group that the pattern lacks is an error in both
    return [r for r in rules if not ("$1" in r.get("replacement", "$1") and "(" not in r.get("regex", "(.*)") and r.get("action") is None)]


def rows(rng, n=25):
    return [(i, {k: rng.choice(VALUES) for k in rng.sample(NAMES, rng.randrange(len(NAMES) + 1))}) for i in range(n)]


@pytest.mark.parametrize("seed", range(14))
def test_rules_on_maps(spark, seed):
    rng = random.Random(seed)
    data, rules = rows(rng), random_rules(rng)
    want = {i: a for i, m in data if (a := apply(m, rules)) is not None}
    got = L.relabel(spark.createDataFrame(data, "id int, labels map<string,string>"), rules).collect()
    assert {r["id"]: {k: v for k, v in r["labels"].items() if v} for r in got} == want, rules


@pytest.mark.parametrize("seed", range(14, 24))
def test_rules_on_columns(spark, seed):
    rng = random.Random(seed)
    data, rules = rows(rng), random_rules(rng)
    want = {i: a for i, m in data if (a := apply(m, rules)) is not None}
    df = spark.createDataFrame([(i, *[m.get(n) for n in NAMES]) for i, m in data], "id int, " + ", ".join(f"{n} string" for n in NAMES))
    got = L.relabel(df, rules)
    assert got.columns[: len(NAMES) + 1] == df.columns
    assert {r["id"]: {k: v for k, v in r.asDict().items() if k != "id" and v} for r in got.collect()} == want, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equality_on_a_promoted_label_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"ns-{i % 4}", "x" if i % 3 else None) for i in range(40)], "id int, ns string, app string").write.parquet(path)
    df = spark.read.parquet(path)
    # also behind a rule that sets another label
    out = L.relabel(df, [{"target": "job", "source": ["ns", "app"], "sep": "/"}, {"action": "keep", "source": ["ns"], "regex": "ns-3"}, {"action": "keep", "source": ["app"], "regex": "x|y"}])
    assert "EqualTo(ns,ns-3)" in plan(out) and "In(app, [x,y])" in plan(out)
    assert {r["job"] for r in out.collect()} == {"ns-3/x"} and out.count() == sum(i % 4 == 3 and i % 3 > 0 for i in range(40))


def test_no_lambda_but_for_labelmap(spark):
    df = spark.createDataFrame(rows(random.Random(0)), "id int, labels map<string,string>")
    rules = [{"source": ["app", "pod"], "target": "job", "regex": "(.*);(.+)", "replacement": "$2"}, {"action": "labeldrop", "names": ["pod"]}, {"action": "keep", "source": ["job"], "regex": "a.*"}]
    for out in (L.relabel(df, rules), L.external_labels(df, {"cluster": "c"}), L.fallback_label(df, "app", ["pod", "job"], F.lit("none"))):
        assert "lambda" not in plan(out)


def test_long_chains_on_one_label_stay_small(spark):
    df = spark.createDataFrame(rows(random.Random(1)), "id int, labels map<string,string>")

    def size(n):
        rules = [{"source": ["app", NAMES[i % len(NAMES)]], "regex": ";(.+)", "target": "app"} for i in range(n)]
        return len(plan(L.relabel(df, [*rules, {"action": "keep", "source": ["app"], "regex": "[a-z].*"}])))

    assert size(24) < 3 * size(12)
