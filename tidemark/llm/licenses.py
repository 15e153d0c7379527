"""Licence scans: tags and notices by Aho-Corasick, tag expressions by a shunting-yard parser.

One automaton holds all phrases, padded with spaces, and runs once over the words of a text; another one
finds the identifier tags in the text itself. What follows a tag's colon on the same line is read as an
expression of licence ids with ``and``, ``or``, ``with`` and parentheses (``with`` binds closest, then
``and``), as far as it is well formed; an id is one of a known family, has a version or begins with
``licenseref-``. Its value is the restriction a user meets: ``or`` lets the user choose the lesser, ``and``
imposes the greater, an exception halves it. A notice inside a longer one (the general public licence in
the lesser one) keeps a base label, but only the longer one counts for the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import folded_words, text_key, texts_of, type_of

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notices: phrase, label.
NOTICES = {
    "apache license": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "free documentation license": "gfdl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open database license": "odbl",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0-1.0",
    "public domain": "public-domain",
    "creative commons": "creative-commons",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "copyright": "copyright",
    "proprietary and confidential": "proprietary",
}

TAG = "spdx-license-identifier"
#: What makes the word copyright a notice: the word behind it, in UTF-8 bytes read one by one.
NOTICE_OF = re.compile("(c|\u00c2\u00a9|(19|20)[0-9][0-9]) ")
EXPRESSION_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+\-]*)")
VERSION = re.compile(r"-v?[0-9]")

#: Restriction, from 0 (none) to 1 (no use allowed), and the labels and families of licence ids that have it.
FAMILIES = {
    0.0: "public-domain cc0 unlicense 0bsd wtfpl mit-0 pddl",
    0.1: "mit bsd isc zlib bsl x11 ncsa postgresql python psf ruby curl libpng openssl unicode-dfs blueoak ntp",
    0.15: "apache afl ecl artistic php upl mulanpsl",
    0.2: "cc-by odc-by ofl",
    0.3: "creative-commons",
    0.4: "mpl epl lgpl cddl cpl apsl ms-pl ms-rl eupl cecill-c",
    0.5: "cc-by-sa odbl gfdl copyright",
    0.6: "gpl cecill osl ncgl",
    0.7: "agpl sspl rpl",
    0.8: "cc-by-nd busl",
    0.9: "cc-by-nc polyform-noncommercial",
    1.0: "proprietary reserved none noassertion",
}
RESTRICTION = {name: value for value, names in FAMILIES.items() for name in names.split()}
#: Of an id that no family begins.
UNKNOWN = 0.8

STRENGTH = {"or": 1, "and": 2, "with": 3}


def family(name: str) -> str | None:
    """The longest family that begins the id at a word end."""
    parts = name.rstrip("+").split("-")
    return next((f for n in range(len(parts), 0, -1) if (f := "-".join(parts[:n])) in RESTRICTION), None)


def restriction(name: str) -> float:
    """Of the family of the id."""
    return RESTRICTION.get(family(name), UNKNOWN)


def is_id(name: str) -> bool:
    """Whether a word behind a tag can be a licence or an exception."""
    return family(name) is not None or name.startswith("licenseref-") or "exception" in name or VERSION.search(name) is not None


def prefix_tokens(text: str) -> list[str]:
    """The longest well-formed expression at the start of the text."""
    best: list[str] = []
    seen: list[str] = []
    open_, operand, at = 0, True, 0  # operand: one is due
    while found := EXPRESSION_TOKEN.match(text, at):
        token, at = found[1].rstrip(".-"), found.end()
        if token == "(" and operand:
            open_ += 1
        elif token == ")" and not operand and open_:
            open_ -= 1
        elif token in STRENGTH and not operand:
            operand = True
        elif token not in "()" and token not in STRENGTH and operand and is_id(token):
            operand = False
        else:
            break
        seen.append(token)
        if not open_ and not operand:
            best = list(seen)
    return best


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and operators of a well-formed expression in postfix order."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in STRENGTH:
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[float, list[str]]:
    """Restriction of a well-formed expression, and its licence ids (exceptions are none)."""
    stack: list[tuple[float, list[str]]] = []
    for token in to_postfix(tokens):
        if token not in STRENGTH:
            stack.append((restriction(token), [token]))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a[0] / 2, a[1]))
        else:
            stack.append(((min if token == "or" else max)(a[0], b[0]), a[1] + b[1]))
    return stack[0]


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of the phrases, met between spaces, and of the tag."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES):
        phrases.add_word(f" {phrase} ", (phrase, len(phrase) + 1))
    tags.add_word(TAG, TAG)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def tag_lines(tags: ahocorasick.Automaton, text: bytes) -> Iterable[str]:
    """What follows each tag and its colon up to the end of the line, lower-cased."""
    plain = text.lower().decode("latin-1")
    for end, _ in tags.iter(plain):
        line = re.compile(r"[^\r\n]*").match(plain, end + 1)[0].lstrip(" \t")
        if line.startswith(":"):
            yield line[1:]


def scan(machines: tuple[ahocorasick.Automaton, ahocorasick.Automaton], text: bytes) -> tuple:
    """n_words, base places, base labels, labels, expressions, score of one text."""
    phrases, tags = machines
    words = folded_words(text)
    padded = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    worst = 0.0
    hits = sorted((end - size, -end, phrase) for end, (phrase, size) in phrases.iter(padded))
    at = word = reached = 0
    for start, end, phrase in hits:
        word += padded.count(" ", at, start)
        at = start
        if phrase in BASE:
            places.append(word)
            base.add(BASE[phrase])
        inside, reached = -end <= reached, max(reached, -end)
        if inside or (phrase == "copyright" and not NOTICE_OF.match(padded, -end + 1)):
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        worst = max(worst, restriction(label))
    for line in tag_lines(tags, text):
        if tokens := prefix_tokens(line):
            value, names = evaluate(tokens)
            expressions.append(" ".join(tokens))
            labels.update(names)
            worst = max(worst, value)
    return len(words), places, sorted(base), sorted(base | labels), expressions, worst


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    machines = automata()
    kinds = {"n_words": pa.int64(), "places": pa.list_(pa.int64()), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "expressions": pa.list_(pa.string()), "score": pa.float64()}
    for batch in batches:
        rows = [scan(machines, t) for t in texts_of(batch)]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], ["doc_id", "text_key", *kinds])


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence evidence of every row, in the partitions of the input.

    ``doc_id, text_key, n_words``; ``places``, the first words (from 0) of the base phrases, in order;
    ``base_labels`` and ``labels``, distinct and sorted; ``expressions`` of identifier tags, as far as well
    formed; ``score``, the greatest restriction of a notice that no longer one covers and of the expressions,
    0 without evidence. The word copyright is a notice before (c), its sign or a year. Null and empty texts
    have no words and no evidence; repeated rows come out alike; other columns are left aside.
    """
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key bigint, n_words bigint, places array<bigint>, base_labels array<string>, labels array<string>, expressions array<string>, score double"
    return narrow.mapInArrow(_scan_batches, schema)
