"""Statistics against a plain count, verdicts against the estimates computed with numpy."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import quality as ql


def brute_stats(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(ql.SYMBOLS, text)), len(lines), len(lines) - len(set(lines)), len(covered)


def vector(s):
    n, chars, symbols, lines, dup, repeat = s
    return [math.log(max(chars, 1) / max(n, 1)), math.asinh(50 * symbols / max(chars, 1)), dup / max(lines, 1), repeat / max(n, 1)]


def brute_distances(vectors):
    x = np.array(vectors, float)
    tol = np.diag([t * t for t in ql.TOLERANCE.values()])

    def rank(v, p):
        return np.sort(v)[max(1, math.ceil(p * len(v))) - 1]

    mean, cov = np.array([rank(c, 0.5) for c in x.T]), np.zeros((4, 4))

    def distances():
        return np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov * ql.CONSISTENCY + tol, (x - mean).T).T)

    for _ in range(ql.STEPS):
        d = distances()
        near = x[d <= rank(d, ql.CORE)]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(4, 4)
    return distances()


def corpus():
    rng = random.Random(11)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([40, 60, 120, 300]))]
        kind = rng.random()
        if kind < 0.08:
            words = [w + "###" for w in words]
        elif kind < 0.16:
            words = words[:6] * 20
        elif kind < 0.3:
            words += words[:7]
        text = "".join(w + rng.choice([" ", " ", "  ", "\n", "\t", "\x0b"]) for w in words)
        if kind > 0.9:
            text += "\nsame line here\n" * 3
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b"])))
    rows += [(900, None, "en", "a"), (901, "", None, None), (None, rows[5][1], "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3]), (902, "one two " * 60_000, "en", "a"), (903, rows[7][1], "xx", "only one")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "q", 3.0) for r in rows], "doc_id long, text string, lang string, source string, n_words string, distance double")
    got = {}
    for r in ql.quality(docs).collect():
        got.setdefault((r["doc_id"], r["lang"], r["source"]), []).append(r)
    groups = {}
    for d, text, lang, source in rows:
        s = brute_stats(text)
        groups.setdefault((lang, source), []).append((d, s, s[0] < 50 or 100 * s[5] > 50 * s[0]))
    seen = 0
    for (lang, source), members in groups.items():
        fine = [m for m in members if not m[2]]
        far = dict(zip([id(m) for m in fine], brute_distances([vector(m[1]) for m in fine]))) if fine else {}
        for m in members:
            for r in got[m[0], lang, source]:
                seen += 1
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == m[1]
                assert r["base_failed"] == m[2]
                if m[2]:
                    assert r["distance"] is None and not r["kept"]
                else:
                    assert r["distance"] == pytest.approx(far[id(m)], rel=1e-6, abs=1e-9)
                    assert r["kept"] == (far[id(m)] <= ql.CUTOFF)
    assert seen >= len(rows)
    kept = [r["kept"] for rs in got.values() for r in rs]
    assert any(kept) and not all(kept)


def test_symbols_are_rejected_and_no_python_runs(spark):
    rng = random.Random(1)
    text = lambda mark: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) + mark for _ in range(100))
    rows = [(i, text("###" if i % 10 == 0 else ""), "en", "a") for i in range(200)]
    found = ql.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in found.where("not kept").collect()} == set(range(0, 200, 10))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_table(spark):
    assert ql.quality(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
