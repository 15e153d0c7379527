"""SimHash groups against a brute-force comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components as graph
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = list(range(len(rows)))
    fps = [brute_fingerprint(t) for _, t in rows]

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return [(d, fps[i], min(groups.get(find(i), [None]), default=None)) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(3)
    words = [f"W{i}" for i in range(400)] + ["é", "ß"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 160):  # near copies, also copies of copies
        parts = rng.choice(rows)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(parts)))
    long = " ".join(rng.choice(words) for _ in range(200_000))
    rows += [(200, ""), (201, None), (202, " \n "), (None, "a b"), (3, rows[3][1]), (3, rows[3][1]), (204, long), (205, long + " end")]
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 1])
def test_groups_equal_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, block int")
    got = simhash.near_duplicates(docs, block=block).collect()
    want = brute_components(rows)
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    kept = simhash.keep_first(docs, block=block)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(str(i) for i in ids) == sorted({str(c) for d, _, c in want if d is not None} | {"None"})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0


def test_fingerprints_near_in_bits_are_all_found():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]

    def groups(pairs):
        root = list(range(len(fps)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for tile in (7, 512):
        tree = simhash.linked(fps, 3, tile)
        assert all(near[i, j] for i, j in tree)
        assert groups(tree) == groups(zip(*np.nonzero(near)))
        assert len(tree) < len(fps)


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_a_round_of_components_stays_short(spark, monkeypatch):
    """The driver keeps track of every task: an edge is read once a side, and nothing is made distinct midway."""
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df, *how, plain=graph.cut: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *how))[1])
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 1), (7, 8), (9, 9), (None, 4)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(plans) > 1 and not any("Union" in p for p in plans[1:])


def test_bands_cover_every_bit(spark):
    row = spark.range(1).select(*[F.expr("-1L").alias("x")]).select(*[simhash._band(F.col("x"), b).alias(f"b{b}") for b in range(4)], *[simhash._rest(F.col("x"), b).alias(f"r{b}") for b in range(4)]).first()
    assert [row[f"b{b}"] for b in range(4)] == [65535] * 4
    assert [row[f"r{b}"] for b in range(4)] == [2**48 - 1] * 4
