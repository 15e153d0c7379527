"""Substring deduplication with suffix automata of reference shards.

A shard whose automaton is sent to every document would make the work the square of the corpus, so documents
and shards are first brought together by content: every window of ``WINDOW`` words is owned by the smallest
hash among its word ``GRAM``-grams, its anchor, and equal windows have equal anchors. Anchors that stand once
in the corpus own no repeated window. For the others the stretches of text that they own meet in the task of
the anchor; the stretches of some anchors are a reference shard of bounded size, whose suffix automaton, with
the number of places of each state, is built from its distinct stretches; these are streamed through it for
matching statistics, and spans of at least a window that have a second place go.

Anchors with more than ``HOT`` places don't meet in one task: their stretches, and the windows of the distinct
ones, are counted by 128-bit hashes in ordinary aggregations, and the counts are joined back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import texts_of, type_of
from tidemark.plans.scratch import cut

WINDOW, GRAM = 35, 8
#: Places of an anchor beyond which its stretches are counted instead of gathered.
HOT = 512
#: Words in the stretches of one reference shard.
SHARD_WORDS = 40_000
#: Distinct words whose hashes a worker keeps.
KEPT = 500_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A mixed hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * base + hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of every anchor, and the first and last start of the windows it owns."""
    if len(hashes) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = rolling(hashes, gram, _BASES[0])
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    owner = np.arange(len(views)) + views.argmin(axis=1)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    return grams[at], at, first, last


class Automaton:
    """Suffix automaton of several word sequences, with the number of places of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], times: int) -> None:
        """Add a sequence that stands in ``times`` places."""
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                p, new = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            self.places[last] += times

    def close(self) -> None:
        """Pass the counts of places on to all suffixes; once, after the last sequence."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def repeated(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the windows of a sequence that stand in two places or more."""
        found = []
        state = matched = 0
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.places[state] > 1:
                found.append(i - window + 1)
        return found


def _anchor_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            found, places, rows = [], [], []
            for row, text in enumerate(texts_of(batch)):
                h, at, _, _ = anchors(known.of(text.split()), window, gram)
                found.append(h)
                places.append(at)
                rows.append(np.full(len(h), row))
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            h = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k1[at], pa.int64()), pa.array(k2[at], pa.int64()), pa.array(place, pa.int64())], ["anchor", "k1", "k2", "place"])

    return run


def _stretch_batches(window: int, gram: int):
    """Stretches that the listed anchors own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            out: dict[str, list] = {"anchor": [], "k1": [], "k2": [], "first": [], "stretch": []}
            for row, (text, wanted) in enumerate(zip(texts_of(batch), batch.column("places").to_pylist())):
                words = text.split()
                wanted = set(wanted)
                for h, at, low, high in zip(*(x.tolist() for x in _signed(anchors(known.of(words), window, gram)))):
                    if at in wanted:
                        out["anchor"].append(h)
                        out["k1"].append(k1[row])
                        out["k2"].append(k2[row])
                        out["first"].append(low)
                        out["stretch"].append(b" ".join(words[low : high + window]))
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("anchor", "k1", "k2", "first")), pa.array(out["stretch"], pa.binary())], list(out))

    return run


def _signed(found):
    return (found[0].view(np.int64), *found[1:])


def _hot_batches(window: int, gram: int):
    """A 128-bit hash of each stretch that the listed anchors own, and those of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = WordHashes()
        names = ("s1", "s2", "k1", "k2", "first")
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            rows: list[tuple[int, ...]] = []
            windows: tuple[list, list] = ([], [])
            for row, (text, wanted) in enumerate(zip(texts_of(batch), batch.column("places").to_pylist())):
                hashes = known.of(text.split())
                _, at, low, high = anchors(hashes, window, gram)
                mine = np.flatnonzero(np.isin(at, wanted))
                if not len(mine):
                    continue
                both = [rolling(hashes, window, b).view(np.int64) for b in _BASES]
                for a, b in zip(low[mine].tolist(), high[mine].tolist()):
                    own = [w[a : b + 1] for w in both]
                    digest = xxhash.xxh3_128_intdigest(own[0].tobytes() + own[1].tobytes())
                    rows.append((*(_signed64(digest >> s) for s in (64, 0)), k1[row], k2[row], a))
                    for out, w in zip(windows, own):
                        out.append(w)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            columns += [pa.array(w, pa.list_(pa.int64())) for w in windows]
            yield pa.RecordBatch.from_arrays(columns, [*names, "w1", "w2"])

    return run


def _signed64(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _shard_batches(window: int, shard_words: int):
    """Repeated spans of stretches; those of an anchor follow one another, equal ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        spans: list[tuple[int, int, int, int]] = []
        shard: list[tuple[bytes, list]] = []  # distinct stretches with their places
        size = 0
        anchor, group = None, {}

        def settle() -> None:
            """Decide the shard's stretches with its automaton."""
            nonlocal shard, size
            ids: dict[bytes, int] = {}
            sequences = [[ids.setdefault(w, len(ids)) for w in text.split(b" ")] for text, _ in shard]
            machine = Automaton()
            for sequence, (_, places) in zip(sequences, shard):
                machine.add(sequence, len(places))
            machine.close()
            for sequence, (_, places) in zip(sequences, shard):
                mark(machine.repeated(sequence, window), places)
            shard, size = [], 0

        def mark(starts: list[int], places: list) -> None:
            if not starts:
                return
            breaks = [i for i in range(1, len(starts)) if starts[i] != starts[i - 1] + 1]
            for a, b in zip([0, *breaks], [*breaks, len(starts)]):
                for k1, k2, first in places:
                    spans.append((k1, k2, first + starts[a], first + starts[b - 1] + window))

        def end_group() -> None:
            nonlocal group, size
            if len(group) == 1:
                ((text, places),) = group.items()
                if len(places) > 1:
                    mark(list(range(text.count(b" ") + 2 - window)), places)
            elif group:
                shard.extend(group.items())
                size += sum(text.count(b" ") + 1 for text in group)
                if size >= shard_words:
                    settle()
            group = {}

        def emit() -> pa.RecordBatch:
            nonlocal spans
            columns = list(zip(*spans)) or [[], [], [], []]
            spans = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "low", "high"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("anchor", "stretch", "k1", "k2", "first")))
            for a, stretch, k1, k2, first in rows:
                if a != anchor:
                    end_group()
                    anchor = a
                group.setdefault(stretch, []).append((k1, k2, first))
            if spans:
                yield emit()
        end_group()
        if shard:
            settle()
        yield emit()

    return run


def _removal_batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        change[s["low"]] += 1
                        change[s["high"]] -= 1
                    stays = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _hot_spans(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Repeated spans of the stretches of anchors with many places.

    Equal stretches are counted first; windows are counted over the distinct ones, each with the number of
    its places. The starts in a stretch are less than a window apart, so its repeated windows cover one span.
    """
    rows = texts.mapInArrow(_hot_batches(window, gram), "s1 bigint, s2 bigint, k1 bigint, k2 bigint, first bigint, w1 array<bigint>, w2 array<bigint>")
    distinct = rows.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.first("w1").alias("w1"), F.first("w2").alias("w2"))
    windows = distinct.select("s1", "s2", "n", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w")).select("s1", "s2", "n", "at", "w.*")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("_places")).where("_places > 1").select("w1", "w2")
    ends = windows.join(twice, ["w1", "w2"]).groupBy("s1", "s2").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    # by one more key than the counts are partitioned by, so that both sides are shuffled for the join itself:
    # only then can adaptive execution split a stretch with very many places
    more = F.xxhash64("s1", "s2").alias("s")
    placed = rows.select(more, "s1", "s2", "k1", "k2", "first")
    return placed.join(ends.select(more, "s1", "s2", "a", "b"), ["s", "s1", "s2"]).select(
        "k1", "k2", (F.col("first") + F.col("a")).alias("low"), (F.col("first") + F.col("b") + window).alias("high")
    )


def repeated_spans(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``k1, k2, low, high``: stretches of words inside windows that stand in two places or more.

    ``keyed`` has ``k1, k2`` (together naming id and text) and ``text``.
    """
    owned = cut(keyed.select("k1", "k2", "text").mapInArrow(_anchor_batches(window, gram), "anchor bigint, k1 bigint, k2 bigint, place bigint"), "anchors")
    many = cut(owned.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot")), "repeated-anchors")
    met = owned.join(many, "anchor")

    def texts(rows: DataFrame) -> DataFrame:
        places = rows.groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
        # all columns, so that the texts are shuffled once for all uses
        return keyed.join(places, ["k1", "k2"]).select(*keyed.columns, "places")

    stretches = texts(met.where("NOT hot")).mapInArrow(_stretch_batches(window, gram), "anchor bigint, k1 bigint, k2 bigint, first bigint, stretch binary")
    together = stretches.repartition("anchor").sortWithinPartitions("anchor")
    spans = together.mapInArrow(_shard_batches(window, shard_words), "k1 bigint, k2 bigint, low bigint, high bigint")
    if not many.where("hot").isEmpty():
        spans = spans.union(_hot_spans(texts(met.where("hot")), window, gram))
    return spans


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row.

    Words are cut at white space and left as they are. Every word in a window of ``window`` words that also
    starts at another place of the corpus, in the same text or another, is removed, at all its places; the
    rest is joined by single spaces. Repeated rows are texts of their own, so all their windows repeat. Null
    and empty texts have no words. Other columns are left aside.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"))
    spans = repeated_spans(keyed, window, gram, hot, shard_words)
    per_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = keyed.join(per_text, ["k1", "k2"], "left").select(*keyed.columns, "spans")
    kind = type_of(docs, "doc_id")
    return joined.mapInArrow(_removal_batches(), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
