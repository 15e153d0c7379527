"""Phrase and proximity matches against a scan of every window of every text."""

import random
import re

import pytest

from tidemark.llm import decontamination as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size, within):
    out = []
    windows = []
    for item, text in items:
        w = words(text)
        windows += [("" if item is None else str(item), w[s : s + size]) for s in range(max(1, len(w) - size + 1)) if w]
    everything = [words(t) for _, t in docs]
    count = {}
    for w in everything:
        for x in w:
            count[x] = count.get(x, 0) + 1
    for (doc, _), w in zip(docs, everything):
        hit, found, near = set(), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
            rare = min((count.get(t, 0), o, t) for o, t in enumerate(win))[2]
            for p, x in enumerate(w):
                if x == rare and all(t in w[max(0, p - within + 1) : p + within] for t in win):
                    near.add(item)
        out.append((str(doc), len(w), sorted(hit), sorted(found), sorted(near)))
    return sorted(out)


def corpus():
    rng = random.Random(7)
    vocabulary = ["the", "of", "an", "é1", "ß", "x9"] + [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 14])))) for i in range(12)]
    items += [(100, ""), (101, None), (None, "the of the of an"), (3, items[3][1]), (102, "Absent WORDS of the corpus")]
    docs = []
    for i in range(80):
        parts = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 30, 90]))]
        if rng.random() < 0.6 and parts:
            at = rng.randrange(len(parts))
            phrase = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.3:
                rng.shuffle(phrase)
            parts[at:at] = phrase
        docs.append((i, rng.choice([" ", "-", ".\n"]).join(parts).upper() if rng.random() < 0.3 else " ".join(parts)))
    docs += [(90, None), (91, ""), (None, items[2][1]), (5, docs[5][1]), (92, " ".join(rng.choice(vocabulary) for _ in range(4000)) + " " + items[1][1])]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_words": 50, "max_terms": 3, "max_windows": 5}])
def test_equals_brute_force(spark, how):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "k", 7) for a, b in docs], "doc_id long, text string, block string, n_words int")
    b = spark.createDataFrame([(a, b, "k") for a, b in items], "item_id long, text string, terms string")
    got = dc.contamination(d, b, size=4, within=7, **how).collect()
    rows = sorted((str(r["doc_id"]), r["n_words"], list(r["hits"]), list(r["items"]), list(r["near_items"])) for r in got)
    assert rows == brute(docs, items, 4, 7)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = dc.contamination(docs, none).collect()
    assert [(r["doc_id"], r["n_words"], r["hits"], r["items"]) for r in row] == [(1, 3, [], [])]
    assert dc.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
