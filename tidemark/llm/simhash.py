"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Fingerprints within ``RADIUS`` differing bits agree in at least one of ``RADIUS + 1`` bands of bits, so
comparing the fingerprints inside each band value misses no link. Inside a band value the distinct
fingerprints are sorted by population count and compared tile against tile with numpy (exclusive-or and
bit counts); as population counts that differ by more than the radius rule out a link, all later tiles
are skipped at the first such tile. A band value with many fingerprints is cut again by the bands of its
remaining bits, which again misses nothing. A tile reports a spanning forest of its links, not the pairs,
so a group of n near copies costs at most n - 1 rows per band and the links between classes stay whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import text_key, texts_of, type_of
from tidemark.plans.scratch import cut

RADIUS = 3
SHINGLE = 3
SEED = 42
BANDS, BAND_BITS = RADIUS + 1, 16
#: A band value with more distinct fingerprints than this is cut again by its remaining bits.
BLOCK = 16_384
#: Fingerprints per side of a tile.
TILE = 512
#: Hashes turned into bits at a time (64 bytes each).
HASHES = 1 << 17


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.array([digest(s, seed) for s in shingles], np.uint64)


def majority(votes: list[np.ndarray], counts: list[int]) -> np.ndarray:
    """Fingerprints from the votes on each bit and the numbers of voters: a bit is 1 where over half of them set it."""
    bits = 2 * np.array(votes, np.int64).reshape(-1, 64) > np.array(counts, np.int64)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.int64).ravel()


def fingerprint_batches(size: int, seed: int):
    """Fingerprints of the texts of each batch; the first column passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            votes, counts = [], []
            for text in texts_of(batch):
                hashes = shingle_hashes(text, size, seed)
                votes.append(bit_votes(hashes))
                counts.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(majority(votes, counts), pa.int64())], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, text_key, fp`` of every document, in the partitions of the input."""
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return narrow.mapInArrow(fingerprint_batches(size, seed), f"doc_id {type_of(docs, 'doc_id')}, text_key bigint, fp bigint")


def linked(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among distinct fingerprints sorted by population count."""
    n = len(fps)
    pops = np.bitwise_count(fps).astype(np.int64)
    root = np.arange(n)
    tree: list[tuple[int, int]] = []

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root[i], root[j]
            while x != root[x]:
                x = root[x]
            while y != root[y]:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                tree.append((i, j))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                return
            root = above

    for low in range(0, n, tile):
        side = fps[low : low + tile]
        top = pops[min(low + tile, n) - 1]
        for other in range(low, n, tile):
            if pops[other] - top > radius:
                break
            near = np.bitwise_count(side[:, None] ^ fps[None, other : other + tile]) <= radius
            i, j = np.nonzero(near)
            i, j = i + low, j + other
            i, j = i[i < j], j[i < j]
            if len(i) > tile:  # one link of each row first: in a dense tile they leave few others to walk through
                first = np.unique(i, return_index=True)[1]
                settle(i[first], j[first])
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
            if len(i):
                settle(i, j)
    return tree


def link_batches(radius: int, tile: int):
    """Links inside each block; the rows of a block follow one another, possibly over several batches."""

    def links(fps: np.ndarray) -> list[tuple[int, int]]:
        return [(int(fps[i]), int(fps[j])) for i, j in linked(fps.view(np.uint64), radius, tile)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        left_keys, left_fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

        for batch in batches:
            keys = np.concatenate([left_keys, batch.column("block").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([left_fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            cuts = np.flatnonzero(np.diff(keys)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            found = []
            starts, ends = np.concatenate([[0], cuts[:-1]]) if len(cuts) else [], cuts
            for a, b in zip(starts, ends):
                if b - a > 1:
                    found += links(fps[a:b])
            left_keys, left_fps = keys[last:].copy(), fps[last:].copy()
            if found:
                yield emit(found)
        if len(left_fps) > 1 and (found := links(left_fps)):
            yield emit(found)

    return run


def _band(fp: Column, band: int) -> Column:
    return F.shiftrightunsigned(fp, band * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def _rest(fp: Column, band: int) -> Column:
    """The 48 bits outside a band."""
    at = band * BAND_BITS
    low = fp.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("bigint")
    high = F.shiftleft(F.shiftrightunsigned(fp, at + BAND_BITS), at) if at + BAND_BITS < 64 else F.lit(0).cast("bigint")
    return low.bitwiseOR(high)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``u, v``: enough of the pairs of fingerprints within the radius to connect whatever they connect.

    ``distinct`` holds each fingerprint once as ``fp``. The radius must be 3 or less.
    """
    if radius > RADIUS:
        raise ValueError(f"bands are cut for a radius of {RADIUS} or less")
    fp = F.col("fp")
    bands = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("band"), _band(fp, b).alias("value"), _rest(fp, b).alias("rest")) for b in range(BANDS)])).alias("k")).select("fp", "k.*")
    hot = bands.groupBy("band", "value").count().where(F.col("count") > block).select("band", "value", F.lit(True).alias("hot"))
    whole = F.shiftleft(F.col("band"), 40).bitwiseOR(F.shiftleft(F.col("value"), 20))
    part = [whole.bitwiseOR(F.lit((s + 1) << 16)).bitwiseOR(F.shiftrightunsigned("rest", 12 * s).bitwiseAND(F.lit(4095))) for s in range(4)]
    blocks = bands.join(hot, ["band", "value"], "left").select("fp", F.explode(F.when(F.col("hot"), F.array(*part)).otherwise(F.array(whole))).alias("block"))
    ordered = blocks.repartition("block").sortWithinPartitions("block", F.bit_count("fp"), "fp")
    return ordered.mapInArrow(link_batches(radius, tile), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_key, fp, component_id`` of every document.

    Texts are lower-cased (A-Z) and cut at white space into shingles of ``size`` words; a shorter text is
    one shingle, and null and texts without words have fingerprint zero, linked like any other. Documents
    whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    doc_id reachable. Rows that repeat are linked at distance zero. Null ids are passed over by the
    minimum. An empty table gives an empty result; further columns are left aside.
    """
    prints = cut(fingerprints(docs, size, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    graph = components(links(classes.select("fp"), radius, block))
    grouped = classes.join(graph.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat the kept id one stays. Rows with a null id can't be named and stay.
    """
    return first_of(docs, near_duplicates(docs, **how))


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """:func:`keep_first` for given groups (``doc_id, component_id``)."""
    found = cut(groups.select("doc_id", "component_id"), "duplicates")
    named = found.where(F.col("doc_id").isNotNull())
    gone = cut(named.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    repeated = cut(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    once = kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_anti").unionByName(once)
