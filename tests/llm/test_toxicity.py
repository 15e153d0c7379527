"""Held-out accuracy, edge cases, and the log ratios against a direct computation."""

import math
import random
import zlib

import pyarrow as pa
import pytest

from tidemark.llm import toxicity as tx


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    bad = ["idiot", "scum"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([3, 20, 200]))]
        kind = rng.random()
        if kind < 0.15:  # a toxic word
            words[rng.randrange(len(words))] = rng.choice(bad)
        elif kind < 0.3:  # a toxic pair of harmless words
            words[0:0] = ["go", "away"]
        elif kind < 0.6:
            words[0:0] = ["go", "w1", "away"]
        rows.append((i, " ".join(words), kind))
        labels.append((i, int(kind < 0.3)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in tx.toxicity(docs, table).collect()}
    truth = dict(labels)
    ids = [i for i in truth if held(i)]
    right = sum((got[i] >= 0.7) == bool(truth[i]) for i in ids)
    assert right / len(ids) > 0.97
    # labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in labels], "doc_id long, toxic int")
    assert {r["doc_id"]: r["score"] for r in tx.toxicity(docs, other).collect()} == got


def test_ratios_equal_direct_computation(spark):
    rows, labels = corpus(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    sets = [(set(t.split()), truth[i], held(i)) for i, t, _ in rows]
    count = [{}, {}]
    shared = {}
    for words, y, out in sets:
        for w in words:
            shared[w] = shared.get(w, 0) + 1
            if not out:
                count[y][w] = count[y].get(w, 0) + 1
    mass = [sum(c.values()) for c in count]
    d = []
    for c in (0, 1):
        once, twice = (sum(v == k for v in count[c].values()) for k in (1, 2))
        d.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)
    n = [sum(1 for _, y, out in sets if y == c and not out) for c in (0, 1)]

    def p(c, w):
        return max(count[c].get(w, 0) - d[c], 0) / mass[c] + d[c] * len(count[c]) / mass[c] * shared[w] / sum(shared.values())

    want = {w.encode() for w in shared if tx._worth((count[0].get(w, 0), count[1].get(w, 0)), (n[1], n[0]))}
    assert set(model.words) == want and b"idiot" in want
    for w, ratio in model.words.items():
        assert ratio == pytest.approx(math.log(p(1, w.decode()) / p(0, w.decode())))
    both = [{}, {}]
    for t, y, out in ((t.split(), truth[i], held(i)) for i, t, _ in rows):
        for pair in set() if out else set(zip(t, t[1:])):
            both[y][pair] = both[y].get(pair, 0) + 1
    dp = []
    for c in (0, 1):
        once, twice = (sum(v == k for v in both[c].values()) for k in (1, 2))
        dp.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)

    def joint(c, v, w):
        mine = [k for (a, _), k in both[c].items() if a == v]
        if not mine:
            return p(c, w)
        return (max(both[c].get((v, w), 0) - dp[c], 0) + dp[c] * len(mine) * p(c, w)) / sum(mine)

    chosen = {pair for pair in {*both[0], *both[1]} if tx._worth((both[0].get(pair, 0), both[1].get(pair, 0)), (n[1], n[0]))}
    assert {(v.decode(), w.decode()) for v, w in model.pairs} == chosen and ("go", "away") in chosen
    assert any(not both[1].get(pair) for pair in chosen)  # of ordinary documents only
    for (v, w), ratio in model.pairs.items():
        assert ratio == pytest.approx(math.log(joint(1, v.decode(), w.decode()) / joint(0, v.decode(), w.decode())))
    # the score: the curve over the mean and root features of the whole text
    after = tx.followers(model)
    for r in tx.score(docs, model).collect()[:40]:
        words = rows[r["doc_id"]][1].encode().split()
        ratios = [model.words.get(w, 0.0) for w in words] + [after.get(v, {}).get(w, 0.0) for v, w in zip(words, words[1:])]
        z = model.curve[0] + model.curve[1] * sum(ratios) / len(words) + model.curve[2] * sum(ratios) / math.sqrt(len(words))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def test_edge_rows(spark):
    rows, labels = corpus(200, 3)
    texts = [(i, t) for i, t, _ in rows] + [(None, "idiot"), (900, None), (901, ""), (902, "w1 " * 100_000), (0, rows[0][1])]
    marks = [(i, y) for i, y in labels] + [(None, 1), (5, None), (6, 1), (6, 0), (777, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = tx.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert len(got) == len(texts)
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (900, 901)}
    assert len(empty) == 1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1
    assert tx.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_pairs_travel_by_first_word():
    """A row per first word of a slot, with its second words; the empty one is the word itself."""
    text = " ".join(f"go w{i}" for i in range(50))
    batch = pa.RecordBatch.from_pydict({"text": [text, "go w1", None], "toxic": pa.array([1, None, 0], pa.int32()), "half": pa.array([0, None, 1], pa.int32())})
    rows = [r for b in tx._count_batches(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == 51 + 51  # the words of all texts, and first words of the labelled one
    go = {r["slot"]: dict(zip(r["seconds"].split(" "), r["times"])) for r in rows if r["first"] == "go"}
    assert go == {4: {"": 2}, 1: {"": 1, **{f"w{i}": 1 for i in range(50)}}}


def test_rows_of_a_bucket_travel_as_one(spark):
    """No more rows than buckets to a slot, however many first words; their counts are those of the texts."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(2000)) for _ in range(12)] + ["go go away", "go", "", None]
    marks = [(i, i % 2, i // 2 % 2) for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array([y for _, y, _ in marks], pa.int32()), "half": pa.array([h for _, _, h in marks], pa.int32())})
    rows = [r for b in tx._packed_batches(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == len({(r["slot"], r["bucket"]) for r in rows}) <= 5 * tx.BUCKETS
    want = {}
    for (_, y, h), text in zip(marks, texts):
        words = (text or "").split()
        for slot, expr in [(s, (w, "")) for w in set(words) for s in (4, 2 * h + y)] + [(2 * h + y, p) for p in set(zip(words, words[1:]))]:
            want.setdefault(expr, [0] * 5)[slot] += 1
    table = tx._table(spark.createDataFrame([tuple(r.values()) for r in rows], "bucket int, slot int, firsts string, seconds string, times array<array<int>>"))
    assert {(r["first"], r["second"]): [r[f"c{s}"] for s in range(5)] for r in table.collect()} == want


def test_labelled_texts_are_not_copied(spark, monkeypatch):
    rows, labels = corpus(60, 4)
    written = []
    monkeypatch.setattr(tx, "cut", lambda df, *how, plain=tx.cut, **more: (written.append(df.columns), plain(df, *how, **more))[1])
    tx.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert written and not any("text" in columns for columns in written)
