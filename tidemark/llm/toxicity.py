"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

Each class has a model with absolute discounting over continuation counts: in how many different documents
of the class an expression stands, so that one document that repeats itself counts once. The mass of the
discounts goes to backoff counts that both classes share, taken from all documents, labelled or not; a rare
expression thus owes its probability mostly to them. A pair backs off to its second word, with the mass that
the discounts of all pairs of its first word leave in the class.

An expression whose class counts differ no more than chance explains (a likelihood-ratio statistic below
``EVIDENCE``) has the shared probability in both classes and cancels out of the comparison. What is left is
a table of log ratios. The log ratio of a text, normalised by its length, becomes a probability through a
logistic curve, fitted on labelled rows by models that have not seen them.

The labelled rows used are bounded by ``FIT_ROWS`` (a fixed share of ids, by hash); so is, with them, the
size of everything that is broadcast. The shared counts cover the whole corpus.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import folded_words, text_key, texts_of, type_of
from tidemark.plans.scratch import cut

#: Labelled rows that the models are fitted on, at most (in expectation).
FIT_ROWS = 200_000
#: Least likelihood-ratio statistic of an expression of its own (chance gives one word in ten thousand more).
EVIDENCE = 15.0
#: Distinct expressions that a task counts before it passes the counts on.
HELD = 150_000
#: Groups of first words, by hash, in which expressions travel (tasks that count them, at most).
BUCKETS = 4096
#: Strength of the prior that keeps the logistic curve finite.
RIDGE = 1e-2


@dataclass
class Model:
    """Log ratios of words and pairs, the mean of the class labels and the logistic curve."""

    words: dict[bytes, float] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], float] = field(default_factory=dict)
    prior: float = 0.5
    curve: tuple[float, float, float] | None = None


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, toxic, half`` of the labelled rows to learn from; contradicting labels count as toxic."""
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = cut(clean.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")), "labels")
    total = one.count()
    hashed = F.xxhash64(F.lit(17), "doc_id")
    share = one if total <= fit_rows else one.where(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
    return cut(share.select("doc_id", "toxic", F.pmod(F.shiftright(hashed, 32), F.lit(2)).cast("int").alias("half")), "fit")


def _pair(a: bytes, b: bytes) -> bytes:
    return a + b" " + b


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Documents per expression: slot 4 for all of them, 2 * half + class for labelled ones, with their pairs.

    A row is a first word with its second words, joined by spaces, and their counts; the word itself has the empty one.
    """
    held = [Counter() for _ in range(5)]

    def flush(slot: int) -> pa.RecordBatch:
        counts, held[slot] = held[slot], Counter()
        found: dict[bytes, tuple[list[bytes], list[int]]] = {}
        for name, n in counts.items():
            first, _, second = name.partition(b" ")
            seconds, times = found.setdefault(first, ([], []))
            seconds.append(second)
            times.append(n)
        words = pa.array(list(found), pa.binary()).cast(pa.string())
        seconds = pa.array([b" ".join(s) for s, _ in found.values()], pa.binary()).cast(pa.string())
        times = pa.array([n for _, n in found.values()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([words, pa.array([slot] * len(found), pa.int32()), seconds, times], ["first", "slot", "seconds", "times"])

    for batch in batches:
        marks = zip(batch.column("toxic").to_pylist(), batch.column("half").to_pylist())
        for text, (toxic, half) in zip(texts_of(batch), marks):
            words = folded_words(text)
            distinct = set(words)
            held[4].update(distinct)
            if toxic is not None:
                slot = 2 * half + toxic
                held[slot].update(distinct)
                held[slot].update(set(map(_pair, words, words[1:])))
                if len(held[slot]) > HELD:
                    yield flush(slot)
            if len(held[4]) > HELD:
                yield flush(4)
    for slot in range(5):
        if held[slot]:
            yield flush(slot)


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The rows of ``_count_batches``, those of a bucket in one row, as a row to a first word costs more than its words.

    First words are joined by spaces, their second words by lines; counts that are all 1 are null.
    """
    for batch in _count_batches(batches):
        of = np.array([zlib.crc32(w) % BUCKETS for w in batch.column("first").cast(pa.binary()).to_pylist()], np.int32)
        order = np.argsort(of, kind="stable")
        of, rows = of[order], batch.take(pa.array(order))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]).astype(np.int32)
        times, ends = rows.column("times").flatten(), np.cumsum(pc.list_value_length(rows.column("times")).to_numpy())
        starts = np.concatenate([[0], ends]).astype(np.int32)
        ones = np.maximum.reduceat(times.to_numpy(), starts[:-1]) == 1
        counts = pa.ListArray.from_arrays(pa.array(starts), times, mask=pa.array(ones))
        words, lines, counts = (pa.ListArray.from_arrays(pa.array(edges), a) for a in (rows.column("first"), rows.column("seconds"), counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[edges[:-1]]), rows.column("slot").slice(0, len(words)), pc.binary_join(words, " "), pc.binary_join(lines, "\n"), counts],
            ["bucket", "slot", "firsts", "seconds", "times"],
        )


def _table(rows: DataFrame) -> DataFrame:
    """``bucket, first, second, c0`` to ``c4``: the counts of each expression by slot, in partitions by bucket of the first word."""
    met = F.arrays_zip(F.split("firsts", " ").alias("first"), F.split("seconds", "\n").alias("line"), F.col("times"))
    lines = rows.repartition("bucket").select("bucket", "slot", F.inline(met).alias("first", "line", "times"))
    pairs = F.arrays_zip(F.split("line", " ").alias("second"), F.coalesce("times", F.array().cast("array<int>")).alias("n"))
    each = lines.select("bucket", "slot", "first", F.inline(pairs).alias("second", "n")).withColumn("n", F.coalesce("n", F.lit(1)))
    return each.groupBy("bucket", "first", "second").agg(*[F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("n"))), F.lit(0)).alias(f"c{s}") for s in range(5)])


def _statistic(x: Column, y: Column, n1: int, n0: int) -> Column:
    """Likelihood ratio of x of n1 toxic and y of n0 ordinary documents against one common share."""
    share = (x + y) / F.lit(float(n1 + n0))

    def part(seen: Column, n: int, p: Column) -> Column:
        return F.when((seen > 0) & (p > 0), seen * F.log(seen / (p * n))).otherwise(0.0)

    return 2 * (part(x, n1, share) + part(y, n0, share) + part(F.lit(n1) - x, n1, 1 - share) + part(F.lit(n0) - y, n0, 1 - share))


def _discount(once: int, twice: int) -> float:
    """Absolute discount from how many expressions stand in one and in two documents."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _ratios(rows: list, contexts: list, totals, docs: tuple[int, int], m: int, pick) -> Model:
    """The table of model ``m``; pick gives (toxic, ordinary) counts of a row; contexts are sums by first word."""
    n1, n0 = docs
    model = Model(prior=(n1 + 1) / (n1 + n0 + 2))
    types, mass = totals["types"], totals["mass"]
    if not (n1 and n0 and mass[0] and mass[1]):
        return model
    discount = [_discount(totals["once"][c], totals["twice"][c]) for c in (0, 1)]
    of_pairs = [_discount(totals["pair_once"][c], totals["pair_twice"][c]) for c in (0, 1)]
    spare = [discount[c] * types[c] / mass[c] for c in (0, 1)]

    def word(counts: tuple[int, int], shared: float) -> tuple[float, float]:
        return tuple(max(counts[c] - discount[c], 0.0) / mass[c] + spare[c] * shared for c in (0, 1))

    known: dict[bytes, tuple[tuple[int, int], float]] = {}
    pairs = []
    for r in rows:
        toxic, ordinary = pick(r)
        if " " in r["expr"]:
            pairs.append((tuple(r["expr"].encode().split(b" ")), (ordinary, toxic)))
        else:
            known[r["expr"].encode()] = ((ordinary, toxic), max(r["c4"], 1) / max(totals["shared"], 1))
    for name, (counts, shared) in known.items():
        if _worth(counts, docs):
            o, t = word(counts, shared)
            model.words[name] = math.log(t / o)
    after = {r["first"].encode(): [(r[f"mass{m}{c}"], r[f"types{m}{c}"]) for c in (0, 1)] for r in contexts}
    for (v, w), counts in pairs:
        if not _worth(counts, docs):
            continue
        own = list(word(*known[w]))
        for c in (0, 1):
            seen, kinds = after[v][c]
            if seen:
                own[c] = (max(counts[c] - of_pairs[c], 0.0) + of_pairs[c] * kinds * own[c]) / seen
        model.pairs[v, w] = math.log(own[1] / own[0])
    return model


def _worth(counts: tuple[int, int], docs: tuple[int, int]) -> bool:
    (y, x), (n1, n0) = counts, docs
    share = (x + y) / (n1 + n0)

    def part(seen, n, p):
        return seen * math.log(seen / (p * n)) if seen > 0 and p > 0 else 0.0

    return 2 * (part(x, n1, share) + part(y, n0, share) + part(n1 - x, n1, 1 - share) + part(n0 - y, n0, 1 - share)) >= EVIDENCE


def followers(model: Model) -> dict[bytes, dict[bytes, float]]:
    """By first and second word, what a pair adds to the log ratio of its second word alone."""
    found: dict[bytes, dict[bytes, float]] = {}
    for (v, w), ratio in model.pairs.items():
        found.setdefault(v, {})[w] = ratio - model.words.get(w, 0.0)
    return found


def features(model: Model, pairs: dict[bytes, dict[bytes, float]], words: list[bytes]) -> tuple[float, float]:
    """The log ratio of a text per word, and per square root of its words; one look-up per word and table."""
    if not words:
        return 0.0, 0.0
    parts = [r for r in map(model.words.get, words) if r is not None]
    parts += [after[w] for after, w in zip(map(pairs.get, words), words[1:]) if after is not None and w in after]
    total = math.fsum(parts)
    return total / len(words), total / math.sqrt(len(words))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression on two features by Newton's method."""
    wide = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(wide @ beta, -35, 35)))
        slope = wide.T @ (p - y) + RIDGE * np.array([0, 1, 1]) * beta
        bend = (wide * (p * (1 - p))[:, None]).T @ wide + RIDGE * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(bend, slope)
        beta = beta - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def probability(model: Model, pair: tuple[float, float]) -> float:
    if model.curve is None:
        return model.prior
    z = model.curve[0] + model.curve[1] * pair[0] + model.curve[2] * pair[1]
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _feature_batches(models):
    """Features of labelled texts by the model that has not seen their half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pairs = [followers(m) for m in models.value]
        for batch in batches:
            halves = batch.column("half").to_pylist()
            got = [features(models.value[1 - h], pairs[1 - h], folded_words(t)) for t, h in zip(texts_of(batch), halves)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("toxic")], ["mean", "root", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows that are not held out."""
    spark = docs.sparkSession
    sample = fit_sample(labels, fit_rows)
    kept = docs.select("doc_id", "text")
    marked = kept.join(F.broadcast(sample), "doc_id", "left")  # bounded by fit_rows
    fit = kept.join(F.broadcast(sample), "doc_id")  # read twice, as a copy of these texts is a good part of the input
    sizes = {(r["half"], r["toxic"]): r["count"] for r in fit.groupBy("half", "toxic").count().collect()}
    packed = "bucket int, slot int, firsts string, seconds string, times array<array<int>>"
    counts = _table(marked.select("text", "toxic", "half").mapInArrow(_packed_batches, packed))
    halves = {0: [0], 1: [1], 2: [0, 1]}  # the halves that each model learns from
    side = {(m, c): sum((F.col(f"c{2 * h + c}") for h in hs), F.lit(0)) for m, hs in halves.items() for c in (0, 1)}
    each = {"mass": lambda n: n, "types": lambda n: n > 0, "once": lambda n: n == 1, "twice": lambda n: n == 2}
    docs_of = {m: tuple(sum(sizes.get((h, c), 0) for h in hs) for c in (1, 0)) for m, hs in halves.items()}

    def sums(prefix: str = "", only: Column | None = None) -> list[Column]:
        values = {f"{prefix}{k}{m}{c}": each[k](n).cast("bigint") for (m, c), n in side.items() for k in each}
        return [F.sum(v if only is None else F.when(only, v)).alias(k) for k, v in values.items()]

    def worth(x: Column, y: Column, m: int) -> Column:
        n1, n0 = docs_of[m]
        return (_statistic(x.cast("double"), y.cast("double"), n1, n0) >= EVIDENCE * 0.999) if n1 and n0 else F.lit(False)

    any_model = lambda: worth(side[0, 1], side[0, 0], 0) | worth(side[1, 1], side[1, 0], 1) | worth(side[2, 1], side[2, 0], 2)
    # a row per first word, with the sums of its pairs and those that are chosen, in the partitions of the counts
    paired = F.col("second") != ""
    own = [F.max(F.when(~paired, F.col(f"c{s}"))).alias(f"w{s}") for s in range(5)]
    chosen = F.collect_list(F.when(paired & any_model(), F.struct("second", *[f"c{s}" for s in range(5)]))).alias("chosen")
    words = cut(counts.groupBy("bucket", "first").agg(*own, *sums("pair_", paired), chosen).drop("bucket"), "counts")

    single = words.select(F.col("first").alias("expr"), *[F.col(f"w{s}").alias(f"c{s}") for s in range(5)])
    total = single.agg(F.sum("c4").alias("shared"), *sums()).first()
    joint = words.agg(*[F.sum(f"pair_{k}{m}{c}").alias(f"pair_{k}{m}{c}") for k in ("once", "twice") for m, c in side]).first()
    totals = {m: {k: [total[f"{k}{m}{c}"] or 0 for c in (0, 1)] for k in each} | {"shared": total["shared"] or 0} for m in halves}
    for m in halves:
        totals[m] |= {f"pair_{k}": [joint[f"pair_{k}{m}{c}"] or 0 for c in (0, 1)] for k in ("once", "twice")}
    ahead = words.where(F.size("chosen") > 0)
    contexts = ahead.select("first", *[F.col(f"pair_{k}{m}{c}").alias(f"{k}{m}{c}") for k in ("mass", "types") for m, c in side]).collect()  # bounded with the sample
    rows = ahead.select("first", F.inline("chosen")).select(F.concat_ws(" ", "first", "second").alias("expr"), *[f"c{s}" for s in range(5)]).collect()
    parts = {w for r in rows for w in r["expr"].split(" ")}
    near = F.broadcast(spark.createDataFrame([(w,) for w in sorted(parts)], "part string"))
    rows += single.where(any_model()).collect()
    known = {r["expr"] for r in rows}
    if parts:
        rows += [r for r in single.join(near, single["expr"] == near["part"]).drop("part").collect() if r["expr"] not in known]

    def pick(m: int):
        return lambda r: tuple(sum(r[f"c{2 * h + c}"] for h in halves[m]) for c in (1, 0))

    models = {m: _ratios(rows, contexts, totals[m], docs_of[m], m, pick(m)) for m in halves}
    whole = models[2]
    if all(docs_of[2]):
        crossed = fit.select("text", "half", "toxic").mapInArrow(_feature_batches(spark.sparkContext.broadcast([models[0], models[1]])), "mean double, root double, toxic int")
        seen = crossed.toPandas()  # three numbers of each row of the bounded sample
        whole.curve = fit_curve(seen[["mean", "root"]].to_numpy(), seen["toxic"].to_numpy().astype(float))
    return whole


def _score_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = model.value
        pairs = followers(known)
        for batch in batches:
            got = [features(known, pairs, folded_words(t)) for t in texts_of(batch)]
            scores = pa.array([probability(known, g) for g in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([g[0] for g in got], pa.float64()), scores], ["doc_id", "text_key", "log_ratio", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_key, log_ratio`` (per word) and ``score`` (0 to 1) of every row, in the partitions of the input."""
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key bigint, log_ratio double, score double"
    return narrow.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) and score every row of ``docs``.

    Null and empty texts have log ratio 0 and the score that goes with it. Rows with a null id are scored
    and not learned from; repeated ids learn each of their rows. Without labels of both classes every score
    is the smoothed share of toxic labels. Other columns are left aside.
    """
    return score(docs, train(docs, labels, fit_rows))
