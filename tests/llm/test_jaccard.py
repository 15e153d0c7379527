"""Groups by five-word Jaccard similarity against a brute-force comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from tidemark.llm import jaccard


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return [(str(d), min(groups.get(find(i), [None]), default=None)) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(8)
    words = [f"W{i}" for i in range(3000)] + ["é"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    line, rows = make(40), []
    for _ in range(40):  # a common passage, and chains of copies with more and more changes about the limit
        base = make(rng.choice([1, 4, 30, 60, 150, 3000])) + (line if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 5])):
            rows.append(" ".join(base))
            for _ in range(rng.randrange(1, 2 + len(base) // 30)):
                base[rng.randrange(len(base))] = rng.choice(words)
    dense = make(146)  # one large group, many of its pairs under the limit
    for _ in range(60):
        copy = list(dense)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(146)] = rng.choice(words)
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    return rows + [(900, ""), (901, None), (902, " \n "), (None, rows[5][1]), (None, "a b"), (3, rows[3][1]), (3, rows[3][1]), (950, "x y z")]


@pytest.mark.parametrize("how", [{}, {"tile": 3, "keep": 20, "bits": 64, "limit": 7}])
def test_groups_equal_brute_force(spark, how):
    """With 64 slots many dissimilar pairs pass, which are verified away."""
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = jaccard.near_duplicates(docs, **how).collect()
    assert sorted(((str(r["doc_id"]), r["component_id"]) for r in got), key=str) == sorted(brute_components(rows), key=str)


def test_stage_drops_copies_beyond_three_bits(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert {str(r["doc_id"]) for r in got.collect()} == {str(c) for d, c in brute_components(rows) if d != "None"} | {"None"}


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_meet_by_their_fingerprints(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints[:20] for _ in range(3)] + prints[:10]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    pairs = [(r["u"], r["v"]) for r in jaccard.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()]
    for u, v in pairs:
        root[find(v)] = find(u)
    near = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i]) if bin(a ^ b).count("1") <= 3]
    assert near and all(find(i) == find(j) for i, j in near)
    groups = [{i for i in root if find(i) == k} for k in set(map(find, root))]
    assert sum(len(g) - 1 for g in groups) <= len(pairs) and len(groups) >= 30 - 10


def test_stage_asks_the_fingerprints(spark, monkeypatch):
    asked = []
    linked = jaccard.linked_fingerprints
    monkeypatch.setattr(jaccard, "linked_fingerprints", lambda fps: asked.append(fps.count()) or linked(fps))
    rows = [(i, " ".join(f"{i}-{k}" for k in range(60)) + end) for i in range(5) for end in ("", " more")]
    assert cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count() == 5
    assert len(asked) == 1 and asked[0] >= 5


def test_last_wave_lists_no_pairs_of_a_group():
    """Classes that all pass the bitmaps, in one job: a forest, not the square of the group."""
    n = 60
    sets = [np.array(sorted({*range(100)} - {k, k + 1}), np.uint64) for k in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "job": [1] * n, "node": list(range(n)), "n": [len(s) for s in sets], "root": list(range(n)), "side": pa.array([0] * n, pa.int32()),
        "bits": pa.array([jaccard.parities(s) for s in sets], pa.binary()),
    })
    out = [r for b in jaccard._link_batches(True, 256)(iter([batch])) for r in b.to_pylist()]
    assert len([r for r in out if r["omitted"] is None]) == n - 1 and [r["omitted"] for r in out][-1] == 1


@pytest.mark.parametrize("cells", [64, 1 << 12, 1 << 24])
def test_common_elements(cells):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    got = jaccard.common(np.array([len(s) for s in sets]), np.concatenate(sets), i, j, cells)
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_a_dense_group_is_decided_on_whole_sets(spark):
    """Copies of one text, some pairs of which are similar and most just under the limit."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(80):
        copy = list(base)
        for k in rng.sample(range(200), rng.choice([3, 4, 5, 6, 7])):
            copy[k] = f"x{rng.random()}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_components(rows))
    assert 1 < len({c for _, c in want}) < 80
    for how in ({}, {"limit": 9, "tile": 4}):
        got = jaccard.near_duplicates(docs, **how).collect()
        assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want
