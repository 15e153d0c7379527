"""Shards and mixtures against the same order computed row by row."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, sharding


def number(seed, *parts):
    return int(hashlib.md5(":".join([str(seed), *["" if p is None else str(p) for p in parts]]).encode()).hexdigest()[:15], 16)


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def corpus(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "b", "c", None])
        rows.append((i, " ".join(rng.choice("xyz") * rng.randint(1, 4) for _ in range(rng.randint(0, 40))), source, "s"))
    return rows + [(n, None, "a", "s"), (n + 1, "", "b", "s"), (None, "null id", "c", "s"), (3, *rows[3][1:]), (3, *rows[3][1:]), (n + 2, "long " * 50_000, "a", "s")]


SCHEMA = "doc_id long, text string, source string, slot string"


@pytest.mark.parametrize("shards", [16, 3])
def test_shards_equal_brute_force(spark, shards):
    rows = corpus()
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=shards)
    assert got.columns == ["doc_id", "text", "source", "shard", "slot"]
    by_source = {}
    for d, t, s, _ in rows:
        by_source.setdefault(s, []).append((number(42, d, md5(t or "")), d, t, s))
    spread = []
    for s, members in by_source.items():
        for r, m in enumerate(sorted(members, key=lambda m: m[0])):
            spread.append(((2 * r + 1) / (2 * len(members)), "{}" if s is None else f'{{"source":"{s}"}}', *m))
    spread.sort(key=lambda x: x[:3])
    n = len(spread)
    want = []
    for g, x in enumerate(spread):
        shard = g * shards // n
        want.append((str(x[3]), x[4], x[5], shard, g - -(-shard * n // shards)))
    assert sorted(map(str, ((str(r["doc_id"]), r["text"], r["source"], r["shard"], r["slot"]) for r in got.collect()))) == sorted(map(str, want))
    sizes = Counter(w[3] for w in want)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, members in by_source.items():
        shares = Counter(w[3] for w in want if w[2] == s)
        assert max(shares.values()) - min(shares[k] for k in range(shards)) <= 2


def test_mixture_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x"))
    got = mixing.mix(docs, repeat_limit=3.0).collect()
    tokens = lambda t: len((t or "").split())
    totals = {}
    for _, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + tokens(t)
    top, least = max(totals.values()), min(totals.values())
    alpha = max(0.0, 1 - math.log(3.0) / math.log(top / least))
    want = []
    for s, total in totals.items():
        quota = round(total * (top / total) ** (1 - alpha))
        passes, left = divmod(quota, total)
        for block in range(passes + (left > 0)):
            run = 0
            members = sorted((number(42, block, d, "" if t is None else md5(t)), d, t) for d, t, x, _ in rows if x == s) if s is not None or True else []
            for place, (_, d, t) in enumerate(members):
                run += tokens(t)
                if block < passes or run <= left:
                    want.append((str(d), s, tokens(t), block, place))
    assert sorted(map(str, ((str(r["doc_id"]), r["source"], r["n_tokens"], r["block"], r["place"]) for r in got))) == sorted(map(str, want))
    used = Counter((r["source"], r["doc_id"]) for r in got)
    assert set(used) == {(s, d) for d, _, s, _ in rows}  # none is lost
    texts = mixing.mixed(docs, repeat_limit=3.0)
    assert texts.columns == docs.columns
    assert Counter(r["doc_id"] for r in texts.collect()) == Counter(r["doc_id"] for r in got)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_entropy_and_budget(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a"] * 700 + ["b"] * 200 + ["c"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = spark.createDataFrame([("a", 7000), ("b", 2000), ("c", 1000)], "_source string, total long")

    def entropy(a):
        p = [t**a for t in (7000, 2000, 1000)]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    alpha = mixing.find_exponent(totals, entropy=1.0)
    assert entropy(alpha) == pytest.approx(1.0, abs=1e-9)
    assert mixing.find_exponent(totals, entropy=5.0) == 0.0 and mixing.find_exponent(totals, entropy=0.1) == 1.0
    got = mixing.mix(docs, entropy=1.0, budget=4000).collect()
    spent = Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
    weights = {s: t**alpha for s, t in (("a", 7000), ("b", 2000), ("c", 1000))}
    for s, w in weights.items():
        assert 0 <= round(4000 * w / sum(weights.values())) - spent[s] < 10
    limited = mixing.find_exponent(totals, repeat_limit=1.5, budget=10_000)
    p = {t: t**limited for t in (7000, 2000, 1000)}
    assert max(10_000 * v / sum(p.values()) / t for t, v in p.items()) == pytest.approx(1.5, abs=1e-6)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.shard(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    words = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in mixing.mix(words).collect()) == [1, 2]
