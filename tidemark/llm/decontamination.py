"""Benchmark decontamination on a distributed positional inverted index.

The index is a table of blocks. A block holds some whole documents (about ``BLOCK_WORDS`` words; one longer
document is a block of its own) as parallel arrays: its documents, and its terms with their counts and
delta-coded positions, counted through the block. Blocks have a bounded size whatever the data, so no term,
however frequent, gathers in one task, and building and searching need no shuffle of texts or postings.

Test windows are searched from their rarest term on, by the counts of the whole index: its positions,
shifted by the term's offset, are the candidate starts, which each further list, shifted alike, thins out.
Windows of which a term is absent from the index, or from a block, cost nothing there. The test set is met
in bounded chunks, one pass over the index each.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.text import FOLDED_WORD, ascii_lower, folded_words, text_key, texts_of, type_of
from tidemark.plans.scratch import cut, scratch_dir

WINDOW = 10
#: In production, the words of a window are close together if less than this many words from its rarest one.
WITHIN = 20
#: Words after which a block is closed.
BLOCK_WORDS = 1 << 17
#: Test vocabularies of up to this many distinct terms are sent to the tasks, so that only their postings are
#: stored; for a larger one the postings of all terms are stored, which gives the same matches.
MAX_TERMS = 300_000
#: Test windows searched in one pass over the index; what a pass finds is written before the next one.
MAX_WINDOWS = 50_000
#: Groups of index blocks in which the counts of a term are added up first.
GROUPS = 64


def _index_batches(vocabulary, id_type: pa.DataType, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = None if vocabulary is None else {t.encode(): i for i, t in enumerate(vocabulary.value)}
        names = None if vocabulary is None else vocabulary.value
        ids: list = []
        keys: list = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        own: dict[bytes, int] = {}
        size = 0

        def block() -> pa.RecordBatch:
            terms = np.concatenate(parts) if parts else np.empty(0, np.int32)
            at = np.flatnonzero(terms >= 0).astype(np.uint32)
            found = terms[at]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            edges = np.flatnonzero(np.diff(found, prepend=-1)) if len(found) else np.empty(0, np.int64)
            ends = np.append(edges[1:], len(found)) if len(edges) else edges
            words = [t.decode() for t in own] if names is None else names
            out = {
                "block": pa.array([uuid.uuid4().hex]),
                "doc_ids": pa.array([ids], pa.list_(id_type)),
                "text_keys": pa.array([keys], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "terms": pa.array([[words[found[a]] for a in edges]], pa.list_(pa.string())),
                "counts": pa.array([[int(b - a) for a, b in zip(edges, ends)]], pa.list_(pa.int64())),
                "postings": pa.array([[np.diff(at[a:b], prepend=np.uint32(0)).astype("<u4").tobytes() for a, b in zip(edges, ends)]], pa.list_(pa.binary())),
            }
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), texts_of(batch)):
                words = folded_words(text)
                if known is None:
                    parts.append(np.array([own.setdefault(w, len(own)) for w in words], np.int32))
                else:
                    parts.append(np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words)))
                ids.append(doc)
                keys.append(key)
                lengths.append(len(words))
                size += len(words)
                if size >= block_words or len(ids) >= block_words:
                    yield block()
                    ids, keys, lengths, parts, own, size = [], [], [], [], {}, 0
        if ids:
            yield block()

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None, block_words: int = BLOCK_WORDS, max_terms: int = MAX_TERMS) -> DataFrame:
    """Positional postings of the texts, written to the shared folder; one row per block.

    With ``terms`` (column ``term``) the postings of other terms are left out, if there are no more than
    ``max_terms``. Null texts have no words; every document is listed in some block.
    """
    spark = docs.sparkSession
    vocabulary = None
    if terms is not None:
        distinct = cut(terms.select("term").distinct(), "terms")
        if distinct.count() <= max_terms:
            vocabulary = spark.sparkContext.broadcast(sorted(r["term"] for r in distinct.collect()))
    kind = type_of(docs, "doc_id")
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = f"block string, doc_ids array<{kind}>, text_keys array<bigint>, lengths array<bigint>, terms array<string>, counts array<bigint>, postings array<binary>"
    blocks = narrow.mapInArrow(_index_batches(vocabulary, to_arrow_type(docs.schema["doc_id"].dataType), block_words), schema)
    path = scratch_dir(spark, "postings")
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id`` (string), ``terms``: every run of ``size`` words of an item; all words of a shorter one.

    Null and wordless items have no window; a null id is the empty string.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(FOLDED_WORD), F.lit(0))
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1)), lambda s: F.slice(F.col("words"), s, size))
    return listed.select("item_id", F.explode(runs).alias("terms")).distinct()


def by_rarity(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows whose terms all occur in the index: ``item_id, size, plan``; plan lists (count, offset, term), rarest first."""
    listed = index.select(F.pmod(F.xxhash64("block"), F.lit(GROUPS)).alias("group"), F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    some = listed.groupBy(F.col("t.terms").alias("term"), "group").agg(F.sum("t.counts").alias("n"))
    counts = some.groupBy("term").agg(F.sum("n").alias("n"))
    parts = windows.select("item_id", "terms", F.posexplode("terms").alias("offset", "term"))
    met = parts.join(counts, "term").groupBy("item_id", "terms").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("plan"))
    return met.where(F.size("plan") == F.size("terms")).select("item_id", F.size("terms").alias("size"), "plan")


def _match_batches(windows, within: int | None, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = defaultdict(list)
        for item, size, plan in windows.value:
            first[plan[0][1]].append((item, size, plan))
        for batch in batches:
            for row in range(batch.num_rows):
                yield match(first, batch.slice(row, 1))

    def match(first, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys, lengths, terms, stored = (batch.column(c)[0].values for c in ("doc_ids", "text_keys", "lengths", "terms", "postings"))
        ends = np.cumsum(lengths.to_numpy())
        where = {t: i for i, t in enumerate(terms.to_pylist())}
        decoded: dict[str, np.ndarray] = {}

        def positions(term: str) -> np.ndarray:
            if term not in decoded:
                decoded[term] = np.cumsum(np.frombuffer(stored[where[term]].as_py(), "<u4"), dtype=np.int64)
            return decoded[term]

        total = int(ends[-1]) if len(ends) else 0
        change = np.zeros(total + 1, np.int64)
        exact, near = defaultdict(set), defaultdict(set)
        for rarest in where.keys() & first.keys():
            for item, size, plan in first[rarest]:
                if not all(t in where for _, t in plan):
                    continue
                starts = positions(rarest) - plan[0][0]
                for offset, term in plan[1:]:
                    others = positions(term)
                    at = np.searchsorted(others, starts + offset)
                    starts = starts[(at < len(others)) & (others[np.minimum(at, len(others) - 1)] == starts + offset)]
                    if not len(starts):
                        break
                if len(starts):
                    doc = np.searchsorted(ends, np.maximum(starts, 0), side="right")
                    inside = (starts >= ends[doc] - lengths.to_numpy()[doc]) & (starts + size <= ends[doc])
                    starts, doc = starts[inside], doc[inside]
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + size, -1)
                    for d in np.unique(doc).tolist():
                        exact[d].add(item)
                if within:
                    for d in nearby(positions, plan, ends, within):
                        near[d].add(item)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        bounds = np.searchsorted(hit, np.concatenate([[0], ends]))
        begins = ends - lengths.to_numpy()
        hits = [(hit[bounds[d] : bounds[d + 1]] - begins[d]).tolist() for d in range(len(ends))]
        out = {
            "block": pa.array([batch.column("block")[0].as_py()] * len(ends), pa.string()),
            "slot": pa.array(range(len(ends)), pa.int64()),
            "doc_id": ids.cast(id_type),
            "text_key": keys,
            "n_words": lengths,
            "hits": pa.array(hits, pa.list_(pa.int64())),
            "items": pa.array([sorted(exact.get(d, ())) for d in range(len(ends))], pa.list_(pa.string())),
            "near_items": pa.array([sorted(near.get(d, ())) for d in range(len(ends))], pa.list_(pa.string())),
        }
        return pa.RecordBatch.from_pydict(out)

    def nearby(positions, plan, ends: np.ndarray, within: int) -> list[int]:
        anchors = positions(plan[0][1])
        for _, term in plan[1:]:
            others = positions(term)
            doc = np.searchsorted(ends, anchors, side="right")
            right = np.searchsorted(others, anchors)
            good = np.zeros(len(anchors), bool)
            for at in (np.minimum(right, len(others) - 1), np.maximum(right - 1, 0)):
                good |= (np.abs(others[at] - anchors) < within) & (np.searchsorted(ends, others[at], side="right") == doc)
            anchors = anchors[good]
            if not len(anchors):
                return []
        return np.unique(np.searchsorted(ends, anchors, side="right")).tolist()

    return run


def matches(index: DataFrame, windows: DataFrame, within: int | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Matches of the windows in every document of the index.

    ``doc_id, text_key, n_words``; ``hits``, the places (from 0) of words inside an exact occurrence of a
    window; ``items``, the ids of items with such a window; ``near_items``, with ``within`` set, the ids of
    items with a window of which every word stands less than ``within`` words from one place of its rarest
    word in the document, in any order.
    """
    spark = index.sparkSession
    id_type = to_arrow_type(index.schema["doc_ids"].dataType.elementType)
    plans = cut(by_rarity(windows, index), "windows")
    chunks = max(1, -(-plans.count() // max_windows))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"block string, slot bigint, doc_id {kind}, text_key bigint, n_words bigint, hits array<bigint>, items array<string>, near_items array<string>"
    found = None
    for chunk in range(chunks):
        mine = plans.where(F.pmod(F.xxhash64("item_id", "plan"), F.lit(chunks)) == chunk) if chunks > 1 else plans
        rows = [(r["item_id"], r["size"], [(p["offset"], p["term"]) for p in r["plan"]]) for r in mine.collect()]
        shared = spark.sparkContext.broadcast(rows)
        part = index.mapInArrow(_match_batches(shared, within, id_type), schema)
        if chunks > 1:
            part = cut(part.where((F.size("items") > 0) | (F.size("near_items") > 0) | F.lit(chunk == 0)), "matches")
            shared.destroy()
        found = part if found is None else found.union(part)
    if chunks > 1:
        first = Window.partitionBy("block", "slot")
        joined = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c).over(first)))) for c in ("hits", "items", "near_items")}
        found = found.withColumns(joined | {"_n": F.row_number().over(first.orderBy("doc_id"))}).where("_n = 1").drop("_n")
    return found.drop("block", "slot")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, within: int | None = None, block_words: int = BLOCK_WORDS, max_terms: int = MAX_TERMS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Index ``docs`` (doc_id, text) and match the windows of ``items`` (item_id, text); see :func:`matches`.

    One row per document row, repeated rows included. Words are runs of digits, letters and non-ASCII
    characters, A-Z lower-cased. Null and empty texts have no words and no match; an empty test set matches
    nothing; other columns are left aside.
    """
    windows = cut(test_windows(items, size), "test-windows")
    index = build_index(docs, windows.select(F.explode("terms").alias("term")), block_words, max_terms)
    return matches(index, windows, within, max_windows)
