"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced at a token
boundary that both have and that is proven stable: a place between a character that is no white space and a
space or line feed. The splitting patterns of the supported tokenizers join such a pair of characters in no
piece, and no special token holds a space, so an encoding of either side stands for itself. Where the
overlap holds no such boundary it is doubled, at last up to the whole text.

Ordinary texts are cut at every stable boundary, and the count of each distinct piece is kept, as words
repeat: the library encodes a piece once and the counts add up to those of the whole text by the same proof.
Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_key, type_of

#: Characters per chunk and in the first overlap of two chunks.
CHUNK, OVERLAP = 24_000, 400
#: Distinct pieces whose counts a worker keeps before it starts anew.
KEPT = 400_000

#: Stable cuts: after no white space of any kind, before a space or a line feed.
STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def encode(model, text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of every token."""
    coded = model.encode(text, add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(coded.ids, coded.offsets)]


def common_boundary(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], cuts: list[int]) -> int | None:
    """The stable cut nearest the middle at which both encodings, in whole-text offsets, have a token boundary."""
    ends, starts = {b for _, _, b in left}, {a for _, a, _ in right}
    shared = [c for c in cuts if c in ends and c in starts]
    return min(shared, key=lambda c: abs(2 * c - cuts[0] - cuts[-1])) if shared else None


def resynchronised(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The encoding of a whole text from overlapping chunks, equal to that in one piece."""
    done: list[tuple[int, int, int]] = []
    at, end = 0, min(len(text), chunk)
    left = encode(model, text[at:end])
    while end < len(text):
        wide = overlap
        while True:
            start = max(at, end - wide)
            if start <= at:  # no stable boundary in the whole chunk: encode on from its start
                end = min(len(text), end + max(chunk, end - at))
                left = [(i, a + at, b + at) for i, a, b in encode(model, text[at:end])]
                break
            to = min(len(text), end + chunk)
            right = [(i, a + start, b + start) for i, a, b in encode(model, text[start:to])]
            cuts = [m.start() for m in STABLE.finditer(text, start, end) if start < m.start() < end]
            cut = common_boundary(left, right, cuts) if cuts else None
            if cut is not None:
                done += [t for t in left if t[2] <= cut]
                at, end, left = cut, to, [t for t in right if t[1] >= cut]
                break
            wide *= 2
    return done + left


def piece_counts(model, texts: list[str], kept: dict[str, int]) -> list[int]:
    """Token counts of texts cut at every stable boundary; ``kept`` has the counts of pieces met before."""
    split = [PIECES.findall(t) for t in texts]
    new = list({p for pieces in split for p in pieces if p not in kept})
    for piece, coded in zip(new, model.encode_batch_fast(new, add_special_tokens=False)):
        kept[piece] = len(coded.ids)
    return [sum(map(kept.__getitem__, pieces)) for pieces in split]


def _count_batches(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = tokenizer(path)
        kept: dict[str, int] = {}
        for batch in batches:
            n_bytes, n_tokens = [], []
            column = batch.column("text")
            for low in range(0, batch.num_rows, 64):
                texts = [t or "" for t in column.slice(low, 64).to_pylist()]
                if len(kept) > KEPT:
                    kept = {}
                counts = [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk and not OTHER_SPACE.search(t)]
                for i, n in zip(short, piece_counts(model, [texts[i] for i in short], kept)):
                    counts[i] = n
                for i in set(range(len(texts))) - set(short):
                    counts[i] = len(resynchronised(model, texts[i], chunk, overlap))
                n_tokens += counts
                n_bytes += [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "text_key", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, text_key, n_bytes, n_tokens`` of every row, in the partitions of the input.

    ``path`` names a tokenizer file that the executors can read, byte-level BPE with the usual splitting of
    words and white space. Special strings inside texts are tokens, none are added. Null and empty texts
    have no tokens; repeated rows are counted alike; other columns are left aside.
    """
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key bigint, n_bytes bigint, n_tokens bigint"
    return narrow.mapInArrow(_count_batches(path or public_tokenizers.path("byte_bpe_50k.json"), chunk, overlap), schema)
