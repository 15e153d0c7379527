"""Counts and spliced encodings against the library on whole texts."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens

MODEL = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = [" ", "  ", "\n", "\n\n", "\t", " ", "　", "\x1c", "\x85", "don't", "it's", "é", "ß", "123", "!!", "<|endoftext|>", "日本", "word", "Longer", "x" * 30, "'ll", "\U0001f600"]


def whole(text):
    return MODEL.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_splices_equal_whole(text):
    got = tokens.resynchronised(MODEL, text, chunk=25, overlap=6)
    assert [i for i, _, _ in got] == whole(text)
    if not tokens.OTHER_SPACE.search(text):
        assert tokens.piece_counts(MODEL, [text], {}) == [len(whole(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert [i for i, _, _ in tokens.resynchronised(MODEL, text, chunk=7, overlap=2)] == whole(text)


@pytest.mark.parametrize("text", ["a" * 70_000, " " * 50_000 + "x", "\n" * 30_000, "word " * 20_000])
def test_long_texts_without_boundaries(text):
    assert len(tokens.resynchronised(MODEL, text)) == len(whole(text))


def test_counts_of_a_table(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.choice([0, 3, 50, 2000]))) for _ in range(60)] + [None, "", " ", "word " * 30_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "null id", "en"), (0, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, chunk=1000, overlap=40).collect())
    assert got == sorted((str(d), len((t or "").encode()), len(whole(t or ""))) for d, t, _ in rows)
    assert tokens.token_counts(docs.limit(0)).count() == 0
