"""Spelling variants: words one edit apart, found through pivotal grams.

A word's *prefix* is its three rarest bigrams (equally rare ones included), in one order for all words. Three
bigrams hold two that do not overlap; dynamic programming picks the two disjoint ones that are rarest
together, the *pivots*. One edit cannot hit both pivots, and if the prefix of ``a`` ends no later in the order
than that of ``b``, the pivot of ``a`` that survives stands in the prefix of ``b``. So every word's pivots look
up the prefixes of all words, which finds each pair from one side at least.

The position limits are in the look-up key. An edit lies behind the first pivot or before the second, so the
word agrees either up to the first pivot, at the same place from the front, or from the second pivot on, at the
same place from the back. What lies beyond the pivot is cut in two halves, of which the edit leaves one as it
is. The key thus holds the pivot, its place, both lengths and more than half of the word, which keeps the lists of a
common gram short without a cap. Every candidate is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import texts_of
from tidemark.plans.scratch import cut

#: Least code points of a word, and least occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in so many has a letter deleted.
DAMAGE = 31
#: A form is so many times as frequent as the word.
TIMES = 10
#: Distinct words that a task counts before it passes the counts on.
HELD = 150_000
#: Longer words are cut into two halves as a whole, without pivots: their halves alone are rare.
LONG = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def runs(text: bytes) -> list[str]:
    """Letter runs of at least ``LEAST_LENGTH`` code points, A-Z lower-cased."""
    return _RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))


def damaged(doc_id, run: str, every: int = DAMAGE) -> str:
    """The run, or the run without one code point where ``every`` divides the checksum of id and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            for run, n in Counter(runs(text)).items():
                word = damaged(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) > HELD:
                yield flush()
                held = Counter()
    if held:
        yield flush()


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words of the documents that are long and frequent enough."""
    counts = docs.select("doc_id", "text").mapInArrow(_count_batches, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            held.update(set(grams(word)))
    yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])


def gram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """Words per bigram; of 90 letters there are 8,100 bigrams at most, however large the vocabulary."""
    rows = vocabulary.select("word").mapInArrow(_gram_batches, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def prefix(word: str, rank: dict[str, int], edits: int = 1) -> list[tuple[int, int]]:
    """(position, rank) of the ``2 * edits + 1`` rarest bigrams and of those as rare as the last, by position."""
    placed = [(rank[g], i) for i, g in enumerate(grams(word))]
    last = sorted(placed)[2 * edits][0]
    return [(i, r) for r, i in placed if r <= last]


def pivots(placed: list[tuple[int, int]], weight: list[int], need: int = 2) -> list[int]:
    """Positions of the ``need`` pairwise disjoint bigrams of least total weight.

    ``best[k]`` walks over the positions from left to right and holds, for k bigrams chosen among those that
    end before the next one may start, the least weight and the positions; ties keep the leftmost choice.
    """
    best: list[tuple[int, list[int]] | None] = [(0, [])] + [None] * need
    waiting: list[tuple[int, int, tuple[int, list[int]]]] = []  # choices whose last bigram may still overlap
    for at, r in placed:
        ready = [w for w in waiting if w[0] + 2 <= at]
        waiting = [w for w in waiting if w[0] + 2 > at]
        for _, k, choice in ready:
            if best[k] is None or choice[0] < best[k][0]:
                best[k] = choice
        for k in range(need):
            if best[k] is not None:
                waiting.append((at, k + 1, (best[k][0] + weight[r], best[k][1] + [at])))
    for _, k, choice in waiting:
        if best[k] is None or choice[0] < best[k][0]:
            best[k] = choice
    return best[need][1]


def keys(word: str, at: int, length: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """What a word of the given length must share with ``word``, besides all up to and with the bigram at ``at``.

    The rest of that other word is cut in two halves by its length; the first must follow the bigram, or the
    second must end the word.
    """
    head, rest = word[: at + 2], length - at - 2
    half = rest // 2
    return (head, word[at + 2 : at + 2 + half]), (head, word[len(word) - (rest - half) :] if rest > half else "")


def _key(side: int, half: int, at: int, length: int, parts: tuple[str, str]) -> int:
    """The key as 64 bits; two keys that fall together only make a candidate more to verify."""
    return xxhash.xxh64_intdigest(f"{side}{half}:{at}:{length}:{parts[0]}\0{parts[1]}".encode()) - (1 << 63)


def _halves(word: str, length: int) -> list[int]:
    """Keys of words beyond ``LONG``: all as if a pivot of no letters stood in front."""
    return [_key(2, half, -2, length, parts) for half, parts in enumerate(keys(word, -2, length))]


def index_entries(word: str, rank: dict[str, int], weight: list[int]) -> list[int]:
    """Keys under which the word is found: one for each bigram of its prefix, side and half."""
    n, back = len(word), word[::-1]
    if n > LONG:
        return _halves(word, n)
    places = [at for at, _ in prefix(word, rank)]
    sides = [(0, word, at) for at in places] + [(1, back, n - 2 - at) for at in places]
    return [_key(side, half, at, n, parts) for side, text, at in sides for half, parts in enumerate(keys(text, at, n))]


def probe_entries(word: str, rank: dict[str, int], weight: list[int]) -> list[int]:
    """Keys that the word looks up: its two pivots among words as long and one letter shorter or longer."""
    n = len(word)
    found: list[int] = []
    if n <= LONG:
        first, second = pivots(prefix(word, rank), weight)
        sides = [(0, word, first), (1, word[::-1], n - 2 - second)]
        lengths = [m for m in (n - 1, n, n + 1) if LEAST_LENGTH <= m <= LONG]
        found = [_key(side, half, at, m, parts) for side, text, at in sides for m in lengths for half, parts in enumerate(keys(text, at, m))]
    for m in (n - 1, n, n + 1):
        if m > LONG:
            found += _halves(word, m)
    return found


def _entry_batches(counts, entries: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        order = sorted(counts.value.items(), key=lambda g: (g[1], g[0]))
        rank, weight = {g: i for i, (g, _) in enumerate(order)}, [n for _, n in order]
        for batch in batches:
            found = [entries(word, rank, weight) for word in batch.column("word").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            taken = batch.take(pa.array(rows))
            key = pa.array([k for f in found for k in f], pa.int64())
            yield pa.RecordBatch.from_arrays([key, taken.column("word"), taken.column("n")], ["key", "word", "n"])

    return run


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` for all words (``word, n``) one edit apart, each pair once with ``a`` before ``b``."""
    counts = vocabulary.sparkSession.sparkContext.broadcast(gram_counts(vocabulary))
    schema = "key bigint, word string, n bigint"
    narrow = vocabulary.select("word", "n")
    index = narrow.mapInArrow(_entry_batches(counts, index_entries), schema).toDF("key", "found", "found_n")
    probes = narrow.mapInArrow(_entry_batches(counts, probe_entries), schema)
    met = probes.join(index, "key").where((F.col("word") != F.col("found")) & (F.levenshtein("word", "found", 1) == 1))
    ahead = F.col("word") < F.col("found")

    def either(x: str, y: str):
        return F.when(ahead, F.col(x)).otherwise(F.col(y))

    return met.select(
        either("word", "found").alias("a"), either("n", "found_n").alias("a_n"), either("found", "word").alias("b"), either("found_n", "n").alias("b_n")
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for a table ``word, form``: the last word reached by going from form to form.

    A form is ``TIMES`` times as frequent, so a chain has at most as many links as the largest count has digits,
    and each round doubles the links that are followed.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = cut(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of distinct words with their counts (``word, n``).

    ``form`` is the most frequent near word (equally frequent ones: the first in code-point order) if it is ``times``
    as frequent as the word, else null; ``root`` is where following forms ends, the word itself if it has none.
    """
    pairs = near_pairs(vocabulary)
    links = pairs.select("a", "a_n", "b", "b_n").union(pairs.select("b", "b_n", "a", "a_n")).toDF("word", "n", "near", "near_n")
    best = links.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    form = F.when(top >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), top.alias("form_n")))
    found = cut(best.select("word", "n_near", form.alias("to")), "near")
    rooted = roots(found.where(F.col("to").isNotNull()).select("word", "to.form"))
    joined = vocabulary.select("word", "n").join(found, "word", "left").join(rooted, "word", "left")
    return joined.select(
        "word", "to.form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "to.form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of ``docs`` (``doc_id, text``); see ``words`` and ``variants``.

    Null and empty texts have no words; a null id counts as empty in the checksum; repeated rows count as
    often as they stand. Other columns are left aside. An empty table gives no rows.
    """
    return variants(cut(words(docs), "words"))
