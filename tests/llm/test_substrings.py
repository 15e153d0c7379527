"""Removed words against a count of every window."""

import random

import pytest

from tidemark.llm import substrings as ss


def brute(rows, window):
    count = {}
    texts = [(d, (t or "").split()) for d, t in rows]
    for _, w in texts:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            count[g] = count.get(g, 0) + 1
    out = []
    for d, w in texts:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(window):
    rng = random.Random(8)
    words = [f"W{i}" for i in range(50)] + ["é", "it,"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [make(window + rng.choice([-1, 0, 1, 12, 40])) for _ in range(8)]
    rows = []
    for i in range(120):
        w = make(rng.choice([0, 3, 30, 120]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(200, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (201, None), (202, ""), (203, " \n"), (204, "same " * 300), (205, "a b " * 100), (206, " ".join(make(30_000))), (207, " ".join(passages[2] + passages[2]))]
    return rows


@pytest.mark.parametrize("how", [{}, {"hot": 1, "shard_words": 1}, {"hot": 4, "shard_words": 200}])
def test_equals_brute_force(spark, how):
    rows = corpus(10)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k1 int")
    got = ss.deduplicated(docs, window=10, gram=3, **how).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute(rows, 10)


def test_default_window(spark):
    rows = corpus(35)
    got = ss.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute(rows, 35)


def test_empty(spark):
    assert ss.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_counts_places():
    rng = random.Random(5)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        times = [rng.randrange(1, 3) for _ in sequences]
        machine = ss.Automaton()
        for s, t in zip(sequences, times):
            machine.add(s, t)
        machine.close()
        for size in (1, 2, 4):
            count = {}
            for s, t in zip(sequences, times):
                for i in range(len(s) - size + 1):
                    count[tuple(s[i : i + size])] = count.get(tuple(s[i : i + size]), 0) + t
            for s in sequences:
                want = [i for i in range(len(s) - size + 1) if count[tuple(s[i : i + size])] > 1]
                assert machine.repeated(s, size) == want
