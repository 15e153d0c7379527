"""Near words against all pairs, pivots against all choices, forms and roots against a walk."""

import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import spelling as sp


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in "".join(c if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return rows


def found(spark, docs, schema="doc_id long, text string"):
    rows = [tuple(r) for r in sp.spelling_variants(spark.createDataFrame(docs, schema)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(letters, n, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12, 30]))) for _ in range(40)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.15)), len(stems) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice(letters)
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcdefgé×ÿ", 2), ("abcdefghijklmnopqrstuvwxyzàçö", 3)])
def test_equals_all_pairs(spark, letters, seed):
    docs = corpus(letters, 120, seed)
    want = brute(docs)
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)
    assert found(spark, docs) == want


def test_chain_of_forms_is_followed_to_its_end(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    docs = [(None, None), (1, ""), (2, "a" * 5000 + " " + "a" * 5000)]
    for w, n in zip(chain, (2, 20, 200, 2000, 20000)):
        # ids whose checksum leaves the word whole
        ids = [i for i in range(1000) if zlib.crc32(f"{i}:{w}".encode()) % 31][0:1]
        docs.append((ids[0], " ".join([w] * n)))
    got = {r[0]: r for r in found(spark, docs)}
    assert {r: got[r][2] for r in chain} == dict.fromkeys(chain, "abcdwzyx")
    assert got["abcdefgh"] == ("abcdefgh", "abcdefgx", "abcdwzyx", 2, 1, 20)
    assert got == {r[0]: r for r in brute(docs)}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs = [(None, "Schnelle schnelle SCHNELLE"), (None, "Schnelle schnelle SCHNELLE"), (3, None), (3, "übermäßig übermäßig, übermässig übermässig")]
    wide = [(i, t, "x", 7, "y") for i, t in docs]
    got = found(spark, wide, "doc_id long, text string, word string, n int, key string")
    assert got == brute(docs)
    assert ("schnelle", None, "schnelle", 6, 0, None) in got or zlib.crc32(b":schnelle") % 31 == 0
    assert found(spark, []) == set()


def test_words_around_the_length_without_pivots(spark, monkeypatch):
    monkeypatch.setattr(sp, "LONG", 9)
    pool = ["abababab", "ababababa", "ababababab", "abababababa", "abababcbab", "bababababa", "cabababab", "abababad"]
    pairs = {(a, b) for a, b in combinations(sorted(pool), 2) if one_edit(a, b)}
    counts = Counter(g for w in pool for g in set(sp.grams(w)))
    order = sorted(counts.items(), key=lambda g: (g[1], g[0]))
    rank, weight = {g: i for i, (g, _) in enumerate(order)}, [n for _, n in order]
    index = {w: set(sp.index_entries(w, rank, weight)) for w in pool}
    probes = {w: set(sp.probe_entries(w, rank, weight)) for w in pool}
    assert {(a, b) for a, b in combinations(sorted(pool), 2) if one_edit(a, b) and (probes[a] & index[b] or probes[b] & index[a])} == pairs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=7, max_size=14), min_size=2, max_size=20, unique=True))
def test_keys_miss_no_pair(pool):
    counts = Counter(g for w in pool for g in set(sp.grams(w)))
    order = sorted(counts.items(), key=lambda g: (g[1], g[0]))
    rank, weight = {g: i for i, (g, _) in enumerate(order)}, [n for _, n in order]
    index = {w: set(sp.index_entries(w, rank, weight)) for w in pool}
    probes = {w: set(sp.probe_entries(w, rank, weight)) for w in pool}
    for a, b in combinations(pool, 2):
        if one_edit(a, b):
            assert probes[a] & index[b] or probes[b] & index[a]


@given(st.lists(st.integers(0, 30), min_size=3, max_size=9, unique=True), st.lists(st.integers(0, 9), min_size=31, max_size=31))
def test_pivots_are_the_rarest_disjoint_choice(places, weight):
    placed = [(p, p) for p in sorted(places)]
    got = sp.pivots(placed, weight)
    assert got[1] - got[0] >= 2
    best = min(weight[a] + weight[b] for a, b in combinations(sorted(places), 2) if b - a >= 2)
    assert weight[got[0]] + weight[got[1]] == best
