"""Language-model scores by class-based bigrams: exchange clustering, class transitions, word emissions.

The probability of a word after another is ``P(class | class of the word before) * P(word | class)``. Classes are
found by exchange: each word is moved to the class that raises the likelihood of the training tokens most, for
which its counts before and after every class are enough (``gains``). A round spreads the words over blocks
that move theirs one after another, each block from the class counts at the start of the round; if a round does
not raise the likelihood, it is undone and only every second, fourth, ... of its moves is made.

What is sent to every task is bounded by parameters, not by the corpus: ``WORDS`` words are clustered singly, every other word
moves with the words of the same ending (``ENDINGS`` groups), and the counts of ``LOOKUP`` words are known in
the task that reads a text. Both sets are cut at a count, so that no tie is broken. All other words of a text
meet their counts in a join. Nothing is left out: all word counts, class transitions and class sizes are those
of all training tokens, and each word has its own emission probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import plain_words, texts_of, type_of
from tidemark.llm.toxicity import held_out
from tidemark.plans.scratch import cut

#: Classes of words; the end of a text is one more.
CLASSES = 64
#: Words clustered singly, groups of the others, and words whose counts are sent out, at most.
WORDS, ENDINGS, LOOKUP = 1 << 14, 1 << 10, 1 << 18
#: Longer words (in bytes) are never sent out.
WIDEST = 64
#: Rounds of exchange, and blocks of words that move at the same time.
ROUNDS, BLOCKS = 5, 16
#: Added to each count of a word, and weight of the class shares against the transitions of a class.
ADDED, PRIOR = 0.5, float(CLASSES)
#: Distinct words, and pairs, that a task holds before it passes the counts on.
HELD, HELD_PAIRS = 150_000, 1 << 19
#: Texts whose listed words a task holds at a time.
STEP = 500
#: Word that stands for the end of a text; no word is empty.
END = ""

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return plain_words(text.translate(_LOWER))


@dataclass
class Model:
    """What scoring needs: bounded tables for every task, and the counts of all words as a DataFrame."""

    words: DataFrame
    lookup: dict[bytes, int] = field(default_factory=dict)  # words by falling count; the clustered ones first
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    clustered: int = 0
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of clustered words, groups, the end
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log10 P(class | class before)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # tokens by class
    types: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # distinct words by class
    tokens: int = 0
    distinct: int = 0
    ends: int = 0
    level: int = 0  # the least level whose words are all sent out


def item_of(word: bytes, place: int | None, clustered: int) -> int:
    """What a word moves as: itself, or the group of its ending."""
    return place if place is not None and place < clustered else clustered + zlib.crc32(word[-3:]) % ENDINGS


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts_of(batch):
            held.update(tokens(text))
            held[b""] += 1
            if len(held) > HELD:
                yield flush()
                held = Counter()
    if held:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all tokens; the end of a text is the empty word."""
    return docs.select("text").mapInArrow(_count_batches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _level(n: Column) -> Column:
    """Counts in steps of a sixteenth of a power of two: few hundred levels for any corpus."""
    return F.floor(F.log2(n.cast("double")) * 16).cast("int")


def _least_level(levels: dict[int, int], most: int) -> int:
    """The least level from which on there are at most ``most`` words."""
    total, least = 0, max(levels, default=0) + 1
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        least = level
    return least


def _pair_batches(shared):
    """Counts of neighbouring items as (a, b, n), the end of a text before its first and behind its last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        places, clustered = shared.value
        end = clustered + ENDINGS
        items = end + 1
        held, size = [], 0
        get = places.get

        def flush() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            for low in range(0, len(codes), 1 << 16):
                part, m = codes[low : low + (1 << 16)], n[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((part // items).astype(np.int32)), pa.array((part % items).astype(np.int32)), pa.array(m.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for text in texts_of(batch):
                found = [end, *[p if (p := get(w)) is not None else clustered + zlib.crc32(w[-3:]) % ENDINGS for w in tokens(text)], end]
                walk = np.array(found, np.int64)
                held.append(walk[:-1] * items + walk[1:])
                size += len(found) - 1
                if size > HELD_PAIRS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(counts: np.ndarray) -> float:
    """Log-likelihood of the training tokens under class counts, but for a part that no move changes."""
    return float(xlogx(counts).sum() - xlogx(counts.sum(1)).sum() - xlogx(counts.sum(0)).sum())


def take_out(counts: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """Class counts without a word of class ``own``; its pairs with itself are in neither vector."""
    rest = counts.copy()
    rest[own, :] -= after
    rest[:, own] -= before
    rest[own, own] -= itself
    return rest


def gains(rest: np.ndarray, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """For every class, the likelihood with the word in that class, less that without the word.

    ``after[c]`` and ``before[c]`` count the word followed and preceded by words of class c, other than itself.
    """
    j, i = np.flatnonzero(after), np.flatnonzero(before)  # few for most words
    rows = (xlogx(rest[:, j] + after[j]) - xlogx(rest[:, j])).sum(1)
    columns = (xlogx(rest[i, :] + before[i, None]) - xlogx(rest[i, :])).sum(0)
    diagonal = np.diag(rest)
    both = xlogx(diagonal + after + before + itself) - xlogx(diagonal)
    one = xlogx(diagonal + after) + xlogx(diagonal + before) - 2 * xlogx(diagonal)
    out, into = rest.sum(1) + before, rest.sum(0) + after  # its neighbours keep their sizes
    spread = xlogx(out + after.sum() + itself) - xlogx(out) + xlogx(into + before.sum() + itself) - xlogx(into)
    return rows + columns + both - one - spread


def _exchange(shared):
    """Moves the items of one block in turn; ``item, own`` with the new class of those that move."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts, classes = shared.value
        counts, wide = counts.copy(), counts.shape[0]
        items, place = np.unique(rows["item"].to_numpy(), return_inverse=True)
        context = np.zeros((len(items), 3, wide))
        np.add.at(context, (place, rows["side"].to_numpy(), rows["other"].to_numpy()), rows["n"].to_numpy())
        moved = []
        for k in np.argsort(-context[:, :2].sum((1, 2)), kind="stable"):
            after, before, itself = context[k, 0], context[k, 1], context[k, 2].sum()
            own = classes[items[k]]
            rest = take_out(counts, own, after, before, itself)
            gained = gains(rest, after, before, itself)[: wide - 1]  # the last class is the end's own
            best = int(np.argmax(gained))
            if gained[best] > gained[own] + 1e-6:
                rest[best, :] += after
                rest[:, best] += before
                rest[best, best] += itself
                counts = rest
                moved.append((int(items[k]), best))
        return pd.DataFrame(moved, columns=["item", "own"]).astype({"item": "int32", "own": "int32"})

    return run


def _contexts(pairs: DataFrame, classes: np.ndarray) -> DataFrame:
    """``item, side, other, n``: counts of an item before (side 0) and behind (1) each class, and with itself (2)."""
    spark = pairs.sparkSession
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"neighbour": np.arange(len(classes), dtype=np.int32), "other": classes.astype(np.int32)})))
    return pairs.join(known, "neighbour").groupBy("item", "side", F.when(F.col("side") == 2, F.lit(0)).otherwise(F.col("other")).alias("other")).agg(F.sum("n").alias("n"))


def _class_counts(contexts: DataFrame, classes: np.ndarray, wide: int) -> np.ndarray:
    """Counts of class pairs; a matrix of ``wide`` by ``wide`` numbers reaches the driver."""
    spark = contexts.sparkSession
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"item": np.arange(len(classes), dtype=np.int32), "own": classes.astype(np.int32)})))
    other = F.when(F.col("side") == 2, F.col("own")).otherwise(F.col("other"))
    rows = contexts.where("side <> 1").join(known, "item").groupBy("own", other.alias("next")).agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((wide, wide))
    for r in rows:
        counts[r["own"], r["next"]] = r["n"]
    return counts


def exchange(pairs: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes after exchange, and the counts of class pairs under them.

    ``pairs`` are counts of neighbouring items (``a, b, n``); the last item is the end, alone in the last class.
    """
    sc, wide = pairs.sparkSession.sparkContext, int(classes[-1]) + 1
    def seen(item: str, side: int, neighbour: str) -> Column:
        return F.struct(F.col(item).alias("item"), F.lit(side).alias("side"), F.col(neighbour).alias("neighbour"))

    each = F.when(F.col("a") == F.col("b"), F.array(seen("a", 2, "b"))).otherwise(F.array(seen("a", 0, "b"), seen("b", 1, "a")))
    # in the order of the items, so that the counts of an item meet in one or two tasks of every round
    flat = cut(pairs.select(F.inline(each), "n").repartitionByRange("item"), "neighbours")
    best, best_counts, now, moved, every = classes, None, classes, [], 1
    for step in range(rounds + 1):
        contexts = cut(_contexts(flat, now), "contexts")
        counts = _class_counts(contexts, now, wide)
        if best_counts is None or likelihood(counts) > likelihood(best_counts):
            best, best_counts, every = now, counts, 1
            blocks = contexts.where(F.col("item") < len(classes) - 1).withColumn("block", F.col("item") % BLOCKS)
            # one row an item at most
            moved = blocks.groupBy("block").applyInPandas(_exchange(sc.broadcast((counts, now))), "item int, own int").collect() if step < rounds else []
        else:
            every *= 2  # too many moved at once
        steps = [r for r in moved if r["item"] % every == step % every]
        if not steps:
            break
        now = best.copy()
        now[[r["item"] for r in steps]] = [r["own"] for r in steps]
    return best, best_counts


def first_classes(sizes: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A start: items by falling count, cut into classes of about equal numbers of tokens; the end alone in the last."""
    order = np.argsort(-sizes[:-1], kind="stable")
    upto = np.concatenate([[0], np.cumsum(sizes[:-1][order])[:-1]])
    found = np.full(len(sizes), classes, np.int64)
    found[order] = np.minimum(classes - 1, (upto * classes) // max(1, int(sizes[:-1].sum())))
    return found


def transition_logs(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed with the shares of the classes."""
    into = counts.sum(0)
    share = (into + 1) / (into.sum() + len(into))
    return np.log10((counts + PRIOR * share[None, :]) / (counts.sum(1, keepdims=True) + PRIOR))


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Count, cluster and smooth over all rows of ``docs`` (``text``)."""
    spark = docs.sparkSession
    words = cut(word_counts(docs), "words")
    real = words.where(F.col("word") != END)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    narrow = real.where(F.octet_length("word") <= WIDEST).withColumn("level", _level(F.col("n")))
    levels = {r["level"]: r["m"] for r in narrow.groupBy("level").agg(F.count("*").alias("m")).collect()}
    low, high = _least_level(levels, LOOKUP), _least_level(levels, WORDS)
    top = narrow.where(F.col("level") >= low).toPandas().sort_values(["n", "word"], ascending=[False, True])  # at most LOOKUP rows
    lookup = {w.encode(): i for i, w in enumerate(top["word"])}
    clustered = int((top["level"] >= high).sum())
    singly = {w: i for w, i in lookup.items() if i < clustered}
    pairs = docs.select("text").mapInArrow(_pair_batches(spark.sparkContext.broadcast((singly, clustered))), "a int, b int, n bigint")
    pairs = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")

    items = clustered + ENDINGS + 1
    sizes = np.zeros(items, np.int64)
    for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row an item at most
        sizes[r["b"]] = r["n"]
    classes, counts = exchange(pairs, first_classes(sizes), rounds)
    types = np.zeros(CLASSES + 1, np.int64)
    np.add.at(types, classes[:clustered], 1)
    rest = real.where((F.octet_length("word") > WIDEST) | (_level(F.col("n")) < high)).select("word").mapInArrow(_group_batches, "place int, n bigint")
    for r in rest.groupBy("place").agg(F.sum("n").alias("n")).collect():  # one row a group
        types[classes[clustered + r["place"]]] += r["n"]
    types[CLASSES] = 1
    class_sizes = np.zeros(CLASSES + 1, np.int64)
    np.add.at(class_sizes, classes, sizes)
    return Model(words, lookup, top["n"].to_numpy(np.int64), clustered, classes, transition_logs(counts), class_sizes, types, total["n"], total["v"], total["ends"], low)


def _group_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Words by the group of their ending."""
    held = np.zeros(ENDINGS, np.int64)
    for batch in batches:
        for word in batch.column("word").cast(pa.binary()).to_pylist():
            held[zlib.crc32(word[-3:]) % ENDINGS] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDINGS, dtype=np.int32)), pa.array(held)], ["place", "n"])


def _score_batches(shared):
    """Everything of a text's scores but the counts of words that were not sent out; those are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lookup, counts, clustered, classes, transitions, sizes, types, n_ends = shared.value
        # class by place in the lookup, then by group
        place_class = np.array([classes[item_of(w, i, clustered)] for w, i in lookup.items()] + list(classes[clustered : clustered + ENDINGS]), np.int64)
        known_logs = np.concatenate([np.log10(counts + ADDED), np.zeros(ENDINGS)])
        class_logs = np.log10(sizes + ADDED * (types + 1))
        end, size, get = CLASSES, len(lookup), lookup.get
        end_log = math.log10(n_ends + ADDED)
        listed = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        for batch in (whole.slice(low, STEP) for whole in batches for low in range(0, whole.num_rows, STEP)):
            n_tokens, n_known, base, score, others = [], [], [], [], []
            for text in texts_of(batch):
                found = tokens(text)
                places = [p if (p := get(w)) is not None else size + zlib.crc32(w[-3:]) % ENDINGS for w in found]
                at = np.array(places, np.int64)
                own = place_class[at] if len(at) else np.zeros(0, np.int64)
                path = np.concatenate([[end], own, [end]])
                sums = float(known_logs[at].sum()) if len(at) else 0.0
                rest = Counter(w for w, p in zip(found, places) if p >= size)
                n_tokens.append(len(found) + 1)
                n_known.append(len(found) - rest.total() + (n_ends > 0))
                base.append(sums + end_log)
                score.append(sums + float(transitions[path[:-1], path[1:]].sum()) - float(class_logs[own].sum()))
                others.append([{"word": w.decode("utf-8", "replace"), "k": k} for w, k in rest.items()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(others, listed)],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.lookup, model.counts, model.clustered, model.classes, model.transitions, model.sizes, model.types, model.ends))
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    schema = f"row bigint, doc_id {type_of(docs, 'doc_id')}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, others array<struct<word:string,k:bigint>>"
    # written once, so that a row keeps its number whatever happens later
    first = cut(narrow.mapInArrow(_score_batches(shared), schema), "scored")
    sent = (F.octet_length("word") <= WIDEST) & (_level(F.col("n")) >= model.level)
    rest = model.words.where((F.col("word") != END) & ~sent)
    met = first.select("row", F.inline("others")).join(rest, "word", "left")
    more = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"))
    base_mass = math.log10(model.tokens + ADDED * (model.distinct + 1))
    joined = first.drop("others").join(more, "row", "left")
    added = F.coalesce("more", F.lit(0.0))
    found = joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + added - F.col("n_tokens") * base_mass).alias("base_score"), (F.col("score") + added).alias("score"),
    )
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def class_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows that are not held out (see ``toxicity.held_out``, five folds) and score every row.

    ``score`` is the log10 probability of the text under the class model, its end included, ``base_score`` under
    single words with ``ADDED`` on every count, and ``perplexity`` that of the class model per token. Null and
    empty texts have an end only. Rows with a null id are learned from and scored; repeated rows count as often as they stand. Other columns
    are left aside. An empty table gives no rows; without training rows all classes are equally likely.
    """
    return score(docs, train(docs.where(~held_out(F.col("doc_id"), 5)), rounds))
