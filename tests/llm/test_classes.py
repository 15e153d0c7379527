"""Class model: counts and scores against direct computation, moves against the likelihood, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import classes as cl


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def split(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ")


def words_of(text):
    return [w for w in split(text) if w]


def corpus(n=400, seed=3):
    """Texts that go round three kinds of words, so that the kind before tells the kind after."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "xyz"]
    docs = []
    for i in range(n):
        length, at = rng.choice([0, 1, 5, 30, 80]), rng.randrange(3)
        words = [rng.choice(kinds[(at + t) % 3]) if rng.random() < 0.95 else rng.choice(["Rare", "ÉTÉ", "q" * 70, f"once{i}"]) for t in range(length)]
        docs.append((i, " ".join(words)))
    return docs + [(None, "x1 y2 z3\tX4"), (None, None), (7, "x1 x1"), (7, "x1 x1")]


def direct(docs):
    """Base columns by the contract."""
    counts = Counter(w for i, t in docs if not held(i) for w in [*words_of(t), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = []
    for i, t in docs:
        words = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        rows.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, base))
    return rows


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def found(spark, docs, schema="doc_id long, text string"):
    return [tuple(r) for r in cl.class_scores(spark.createDataFrame(docs, schema)).collect()]


def model_scores(model, counts, docs):
    """The class model's score of each text from the model's tables, one token after another."""
    place = {w.decode(): i for w, i in model.lookup.items()}
    own = lambda w: int(model.classes[cl.item_of(w.encode(), place.get(w), model.clustered)])
    out = []
    for _, t in docs:
        before, total = cl.CLASSES, 0.0
        for w in words_of(t):
            c = own(w)
            total += model.transitions[before, c] + math.log10((counts[w] + 0.5) / (model.sizes[c] + 0.5 * (model.types[c] + 1)))
            before = c
        out.append(total + model.transitions[before, cl.CLASSES])
    return out


@pytest.mark.parametrize("sent, single", [(1 << 18, 1 << 14), (60, 20), (0, 0)])
def test_scores_equal_direct_computation(spark, monkeypatch, sent, single):
    monkeypatch.setattr(cl, "LOOKUP", sent)
    monkeypatch.setattr(cl, "WORDS", single)
    docs = corpus(150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    train = spark.createDataFrame([d for d in docs if not held(d[0])], "doc_id long, text string")
    model = cl.train(train, rounds=2)
    assert len(model.lookup) <= sent and model.clustered <= single
    got = [tuple(r) for r in cl.score(df, model).collect()]
    same([g[:6] for g in got], direct(docs))
    counts = Counter(w for i, t in docs if not held(i) for w in words_of(t))
    want = model_scores(model, counts, docs)
    assert sorted(g[6] for g in got) == pytest.approx(sorted(want), rel=1e-9)
    assert all(g[7] == pytest.approx(10 ** (-g[6] / g[2])) for g in got)
    # every word of the training texts has one class, and the classes hold all tokens
    assert model.types.sum() == len(counts) + 1
    assert model.sizes.sum() == model.tokens == sum(counts.values()) + sum(not held(i) for i, _ in docs)
    assert np.allclose((10**model.transitions).sum(1), 1)
    mass = sum((counts[w] + 0.5) / (model.sizes[c] + 0.5 * (model.types[c] + 1)) for w in counts if (c := int(model.classes[cl.item_of(w.encode(), {k.decode(): i for k, i in model.lookup.items()}.get(w), model.clustered)])) == (first := int(model.classes[0])))
    assert mass + 0.5 / (model.sizes[first] + 0.5 * (model.types[first] + 1)) == pytest.approx(1)


def test_exchange_raises_held_out_scores(spark):
    docs = corpus(400)
    got = [g for g in found(spark, docs) if g[1]]
    base, score, n = (sum(g[k] for g in got) for k in (5, 6, 2))
    assert score > base + 0.2 * n  # about log10(3) less for each word whose kind is known
    start = [g for g in [tuple(r) for r in cl.class_scores(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0).collect()] if g[1]]
    assert score > sum(g[6] for g in start)


def test_empty_tables_clashing_columns_and_long_texts(spark):
    schema = "doc_id long, text string, row long, word string, n int, base double, others string"
    assert found(spark, [], schema) == []
    docs = [(1, "a b " * 50_000), (2, "w" * 200_000), (3, ""), (4, None), (5, "A\x0bB")]
    got = found(spark, [(*d, 5, "w", 1, 0.5, "o") for d in docs], schema)
    same([g[:6] for g in got], direct(docs))
    only_held = [(i, "a b") for i in range(50) if held(i)]
    got = found(spark, only_held)
    assert {g[3:6] for g in got} == {(0, 0, 0.0)}
    assert {round(g[6], 9) for g in got} == {round(3 * math.log10(1 / (cl.CLASSES + 1)), 9)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=2, max_size=40), st.integers(0, 5), st.integers(0, 2**32 - 1))
def test_gain_is_the_difference_in_likelihood(walk, word, seed):
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, 3, 6)

    def counts(of):
        table = np.zeros((3, 3))
        for a, b in zip(walk, walk[1:]):
            table[of[a], of[b]] += 1
        return table

    after, before, itself = np.zeros(3), np.zeros(3), 0.0
    for a, b in zip(walk, walk[1:]):
        if a == b == word:
            itself += 1
        elif a == word:
            after[classes[b]] += 1
        elif b == word:
            before[classes[a]] += 1
    rest = cl.take_out(counts(classes), classes[word], after, before, itself)
    got = cl.gains(rest, after, before, itself)
    for c in range(3):
        moved = classes.copy()
        moved[word] = c
        assert got[c] - got[classes[word]] == pytest.approx(cl.likelihood(counts(moved)) - cl.likelihood(counts(classes)), abs=1e-8)


def test_levels_cut_at_a_count():
    assert cl._least_level({0: 100, 16: 10, 25: 5}, 20) == 16
    assert cl._least_level({0: 100, 16: 10, 25: 5}, 3) == 26
    assert cl._least_level({}, 5) == 1 and cl._least_level({3: 5}, 5) == 3
