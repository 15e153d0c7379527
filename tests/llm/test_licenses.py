"""Places, labels, expressions and scores against a plain scan; expressions also against hand-made values."""

import random
import re

import pytest

from tidemark.llm import licenses as lc


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def descend(tokens):
    """Value and ids of the longest expression that begins the tokens, or None: recursive descent over each prefix."""

    def primary(at):
        if at < len(now) and now[at] == "(":
            value, names, at = either(at + 1)
            if at >= len(now) or now[at] != ")":
                raise ValueError
            return value, names, at + 1
        if at >= len(now) or now[at] in ("(", ")", "and", "or", "with") or not known(now[at]):
            raise ValueError
        return lc.restriction(now[at]), [now[at]], at + 1

    def chain(word, below, join):
        def run(at):
            value, names, at = below(at)
            while at < len(now) and now[at] == word:
                more, others, at = below(at + 1)
                value, names = join(value, more), names if word == "with" else names + others
            return value, names, at

        return run

    def known(name):
        return any(name.rstrip("+") == k or name.startswith(k + "-") for k in lc.RESTRICTION) or name.startswith("licenseref-") or "exception" in name or bool(re.search(r"-v?\d", name))

    both = chain("and", chain("with", primary, lambda a, b: a / 2), max)
    either = chain("or", both, min)
    for n in range(len(tokens), 0, -1):
        now = tokens[:n]
        try:
            value, names, at = either(0)
        except ValueError:
            continue
        if at == n:
            return value, names, " ".join(now)
    return None


def brute(text):
    words = fold(text)
    hits = [(i, i + len(p.split()), p) for p in (*lc.BASE, *lc.NOTICES) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = sorted(i for i, _, p in hits if p in lc.BASE)
    base = {lc.BASE[p] for _, _, p in hits if p in lc.BASE}
    labels, values, expressions = set(base), [0.0], []
    for i, j, p in hits:
        if any(a <= i and j <= b and b - a > j - i for a, b, _ in hits):
            continue
        if p == "copyright" and not (j < len(words) and re.fullmatch("c|©|(19|20)[0-9]{2}", words[j])):
            continue
        label = lc.BASE.get(p) or lc.NOTICES[p]
        labels.add(label)
        values.append(lc.restriction(label))
    for line in re.split(r"[\r\n]", (text or "").lower()):
        for tag in re.finditer("spdx-license-identifier(?=[ \t]*:([^\r\n]*))", line):
            rest = re.match(r"(?:[ \t]*(?:[()]|[a-z0-9][a-z0-9.+\-]*))*", tag[1])[0]
            tokens = [t.rstrip(".-") for t in re.findall(r"[()]|[a-z0-9][a-z0-9.+\-]*", rest)]
            if found := descend(tokens):
                values.append(found[0])
                labels |= set(found[1])
                expressions.append(found[2])
    return len(words), places, sorted(base), sorted(labels), expressions, max(values)


@pytest.mark.parametrize(
    "text, value, names",
    [
        ("mit", 0.1, ["mit"]),
        ("mit or gpl-3.0-only and apache-2.0", 0.1, ["mit", "gpl-3.0-only", "apache-2.0"]),
        ("(mit or gpl-3.0) and apache-2.0", 0.15, ["mit", "gpl-3.0", "apache-2.0"]),
        ("gpl-2.0 with classpath-exception-2.0 and mit", 0.3, ["gpl-2.0", "mit"]),
        ("gpl-2.0 or ((mit))) rest", 0.1, ["gpl-2.0", "mit"]),
        ("mit. the words that follow", 0.1, ["mit"]),
        ("my-own-1.0 and mit or", 0.8, ["my-own-1.0", "mit"]),
    ],
)
def test_expressions(text, value, names):
    got = lc.evaluate(lc.prefix_tokens(text))
    assert got == (pytest.approx(value), names)


@pytest.mark.parametrize("text", ["", "and mit", "(mit or", ") mit", "()"])
def test_malformed(text):
    assert lc.prefix_tokens(text) == [] or lc.prefix_tokens(text) == ["mit"]
    assert lc.prefix_tokens("(mit or") == []


def test_scan_of_a_table(spark):
    rng = random.Random(4)
    parts = ["CC BY", "cc-by", "cc by cc by", "General Public License", "GNU Lesser General Public License", "all rights", "reserved", "All rights RESERVED", "general", "é", "wort", "\n", "cc", "by", "nc"]
    parts += ["SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\n", "SPDX-License-Identifier : GPL-2.0+ WITH", "Classpath-exception-2.0", "public domain", "Copyright", "(c)", "© 2020", "1999", "OR", "LicenseRef-own", "(", ")", "SPDX-License-Identifier:"]
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(120)] + [None, "", "cc by " * 5_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = lc.license_scan(docs).collect()
    columns = ["n_words", "places", "base_labels", "labels", "expressions", "score"]
    assert sorted((str(r["doc_id"]), *map(str, (r[c] for c in columns))) for r in got) == sorted((str(d), *map(str, brute(t))) for d, t, _ in rows)
    for r in got:
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert lc.license_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, labels, expressions, score",
    [
        ("x\n# SPDX-License-Identifier: MIT OR Apache-2.0\nrest", ["apache-2.0", "mit"], ["mit or apache-2.0"], 0.1),
        ("SPDX-License-Identifier:\n\nHello world", [], [], 0),
        ("Every file needs an SPDX-License-Identifier tag", [], [], 0),
        ("SPDX-License-Identifier: tag", [], [], 0),
        ("SPDX License Identifier MIT", [], [], 0),
        ("/* SPDX-License-Identifier: MIT */ and gpl-2.0", ["mit"], ["mit"], 0.1),
        ("GNU Lesser General Public License", ["gpl", "lgpl"], [], 0.4),
        ("a copyright question", [], [], 0),
        ("Copyright © 2020 them", ["copyright"], [], 0.5),
    ],
)
def test_labels(text, labels, expressions, score):
    assert lc.scan(lc.automata(), text.encode())[3:] == (labels, expressions, score) == brute(text)[3:]
