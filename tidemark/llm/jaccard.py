"""Near-duplicates by SimHash fingerprints and the exact Jaccard similarity of word shingles.

Texts are sets of hashed shingles; equal sets are one class. The classes whose fingerprints of the same shingles
link (``simhash.links``) are verified on the whole sets and give the first components. Copies of similarity
``SHARE`` often differ in more bits than that, so what fingerprints miss is found by prefixes and parity bitmaps,
of which every step misses nothing. In any fixed order of all shingles, two sets of similarity ``SHARE`` or more have one in common among the first
``n - ceil(SHARE * n) + 1`` of each, so the classes that share such a shingle form a block. The order puts
shingles that many documents share last, by counts over all of them, which steers the size of blocks, never
the result. Inside a block classes are compared tile against tile with numpy: sizes must agree to ``SHARE``,
and the parities of the shingles of each slot differ in no more slots than the sets differ in shingles; a
bitmap has about as many slots as its set has shingles. What passes is verified on the whole sets.

Blocks are lists of classes only; bitmaps meet them once a wave, and a wave looks only at pairs across the components
known before it. The first wave takes a spanning forest of the pairs of
each block that may be similar, of blocks beyond ``BLOCK`` one of each random part. The second one joins the components that
parts of a large block left apart, by one class of each. The last one takes
the blocks of which the first left pairs out, where several components remain, and large blocks, those as a
grid of part against part, each a task of its own. The forests of classes of this last wave say which ones may belong together;
each such cluster meets once, with its whole sets, and every pair across components that may be similar is decided there.
So no list of pairs is ever longer than the lists of classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import bit_votes, majority, shingle_hashes
from tidemark.llm.simhash import links as linked_fingerprints
from tidemark.llm.text import text_key, texts_of, type_of
from tidemark.plans.scratch import cut, tables

SHINGLE = 5
#: Similarity of 4/5 or more, in whole numbers.
SHARE = (4, 5)
#: Most slots of a parity bitmap (a power of two, 64 or more).
BITS = 4096
#: Most shingles that the order puts last; they are sent to every task (16 bytes each).
FREQUENT = 262_144
#: Classes of a block that one task compares.
BLOCK = 512
#: Classes per side of a tile.
TILE = 256
#: Classes, and shingles of them (8 bytes each), of a side of a task that compares whole sets.
CLUSTER, ENTRIES = 1024, 1 << 19
#: Bits of a table of classes by shingles that are held unpacked at a time (a byte each).
CELLS = 1 << 24


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; of the whole sequence where it is shorter."""
    return np.unique(shingle_hashes(text, size))


def similar(both, a, b):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common elements have similarity ``SHARE`` or more."""
    return (SHARE[0] + SHARE[1]) * both >= SHARE[0] * (a + b)


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first elements, among which similar sets meet: others before ``frequent``, by place and hash."""
    n = len(hashes)
    if not n:
        return hashes
    length = n + SHARE[0] * n // -SHARE[1] + 1
    place = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent[:, 0], hashes), len(frequent) - 1)
        known = frequent[at, 0] == hashes
        place[known] = frequent[at[known], 1].astype(np.int64)
    return hashes[np.lexsort((hashes, place))[:length]]


def parities(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """Whether each slot, by the low bits of the hash, holds an odd number of elements.

    There are as many slots as the next power of two from the number of elements, 64 to ``bits``.
    """
    slots = min(max(64, 1 << (len(hashes) - 1).bit_length()), bits) if len(hashes) else 64
    place = (hashes & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=slots).astype(np.uint8) & 1).tobytes()


def _shared_batches(size: int):
    """Shingles that two or more different texts of a batch share, with their count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets = list({s.tobytes(): s for s in (shingle_set(t, size) for t in texts_of(batch))}.values())
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": found[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})

    return run


def _sketch_batches(frequent, size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            sets, votes, counts = [], [], []
            for text in texts_of(batch):
                hashes = shingle_hashes(text, size)
                votes.append(bit_votes(hashes))
                counts.append(len(hashes))
                sets.append(np.unique(hashes))
            out = {
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "node": pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64), pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "fp": pa.array(majority(votes, counts), pa.int64()),
                "bits": pa.array([parities(s, bits) for s in sets], pa.binary()),
                "prefix": pa.array([prefix(s, last).view(np.int64) for s in sets], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterable[pa.Table]:
    """Rows of each key, which follow one another, possibly over several batches; single rows are left out."""
    held: list[pa.RecordBatch] = []
    mine = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and keys[a] != mine:
                if sum(p.num_rows for p in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            mine = keys[a]
            held.append(batch.slice(a, b - a))
    if held and sum(p.num_rows for p in held) > 1:
        yield pa.Table.from_batches(held)


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Blocks of one shingle each, named by their members, so that equal blocks become one."""
    blocks, nodes, held = [], [], 0
    for group in _grouped(batches, "shingle"):
        members = np.sort(group.column("node").to_numpy())
        name = np.array([xxhash.xxh64_intdigest(members.tobytes())], np.uint64).view(np.int64)
        blocks.append(np.repeat(name, len(members)))
        nodes.append(members)
        held += len(members)
        if held > 1 << 16:
            yield pa.RecordBatch.from_pydict({"block": np.concatenate(blocks), "node": np.concatenate(nodes)})
            blocks, nodes, held = [], [], 0
    if blocks:
        yield pa.RecordBatch.from_pydict({"block": np.concatenate(blocks), "node": np.concatenate(nodes)})


def candidates(sizes: np.ndarray, bits: list[bytes], tile: int = TILE) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, tile by tile, that sizes (ascending) and parities don't rule out.

    A tile holds bitmaps of one length; a longer bitmap is folded to the length of the shorter one.
    """
    n, lengths = len(sizes), np.fromiter(map(len, bits), np.int64, len(bits))
    edges = sorted({*range(0, n, tile), *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), n})
    tiles = [(x, np.frombuffer(b"".join(bits[x:y]), "<u8").reshape(y - x, -1), sizes[x:y]) for x, y in zip(edges, edges[1:])]
    for at, (low, a, size) in enumerate(tiles):
        for other, b, more in tiles[at:]:
            if not similar(size[-1], size[-1], more[0]):
                break
            while b.shape[1] > a.shape[1]:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            if len(a) * len(b) <= tile:  # most blocks are small
                apart = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=np.int64)
            else:
                apart = np.zeros((len(a), len(b)), np.int64)
                for word in range(a.shape[1]):
                    apart += np.bitwise_count(a[:, None, word] ^ b[None, :, word])
            total = size[:, None] + more[None, :]
            near = similar(size[:, None], size[:, None], more[None, :]) & similar((total - apart) / 2, total, 0)
            i, j = np.nonzero(near)
            i, j = i + low, j + other
            yield i[i < j], j[i < j]


class _Forest:
    """Trees over the rows of a job; rows of one root are in one tree from the start."""

    def __init__(self, roots: np.ndarray):
        _, first, which = np.unique(roots, return_index=True, return_inverse=True)
        self.up = first[which].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def fresh(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Places of the pairs that join two trees, one after another."""
        found = []
        for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                found.append(at)
        return found


def _across(group: pa.Table, tile: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a job that may be similar, have different roots and lie on different sides (or on side 0)."""
    sizes, roots, sides = (group.column(c).to_numpy() for c in ("n", "root", "side"))
    for i, j in candidates(sizes, group.column("bits").to_pylist(), tile):
        keep = (roots[i] != roots[j]) & ((sides[i] != sides[j]) | (sides[i] == 0))
        if keep.any():
            yield i[keep], j[keep]


def _link_batches(whole: bool, tile: int):
    """A spanning forest of the pairs of each job that may be similar: of its roots or, where ``whole``, its classes.

    A job of whose pairs the forest left some out is named in ``omitted``, in a row of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for group in _grouped(batches, "job"):
            nodes, omitted = group.column("node").to_numpy(), False
            forest = _Forest(nodes if whole else group.column("root").to_numpy())
            for i, j in _across(group, tile):
                fresh = forest.fresh(i, j)
                omitted |= len(fresh) < len(i)
                if fresh:
                    i, j = i[fresh], j[fresh]
                    none = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_pydict({"u": np.minimum(nodes[i], nodes[j]), "v": np.maximum(nodes[i], nodes[j]), "omitted": none})
            if omitted:
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({"u": none, "v": none, "omitted": group.column("job")[:1].combine_chunks()})

    return run


def common(lengths: np.ndarray, shingles: np.ndarray, i: np.ndarray, j: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """How many elements the sets of each index pair share; ``shingles`` holds the sets one after another.

    Only shingles of several sets count; they are columns of a table of bits, of which a bounded part is made at a time.
    """
    n, both = len(lengths), np.zeros(len(i), np.int64)
    _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(n), lengths)[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(64, cells // max(n, 1) // 64 * 64)
    step = max(1, cells // width)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        table = np.zeros((n, width), bool)
        table[row[a:b], column[a:b] - low] = True
        words = np.packbits(table, axis=1).view(np.uint64)
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            both[part] += np.bitwise_count(words[i[part]] & words[j[part]]).sum(axis=1, dtype=np.int64)
    return both


def _cluster_batches(tile: int):
    """A spanning forest of the similar pairs of each job across roots, by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for group in _grouped(batches, "job"):
            pairs = list(_across(group, tile))
            if not pairs:
                continue
            i, j = (np.concatenate(side) for side in zip(*pairs))
            nodes, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
            shingles = np.concatenate([c.flatten().to_numpy() for c in group.column("shingles").chunks])
            near = similar(common(sizes, shingles, i, j), sizes[i], sizes[j])
            i, j = i[near], j[near]
            fresh = _Forest(group.column("root").to_numpy()).fresh(i, j)
            if fresh:
                i, j = nodes[i[fresh]], nodes[j[fresh]]
                yield pa.RecordBatch.from_pydict({"u": np.minimum(i, j), "v": np.maximum(i, j)})

    return run


def _jobs(members: DataFrame, whole: bool, limit: int, entries: int | None = None) -> DataFrame:
    """``job, node, root, side`` of ``members`` (``block, node, root``), where a job is what one task compares.

    A block of more than ``limit`` classes, or with ``entries`` of more shingles (``n``) than that, is dealt into
    random parts: a job each or, where ``whole``, a job for every two of them, whose members have sides 1 and 2, and for each with itself (side 0).
    """
    most = F.ceil(F.count("*") / limit)
    if entries is not None:
        most = F.greatest(most, F.least(F.count("*"), F.ceil(F.sum("n") / entries)))
    parts = members.groupBy("block").agg(most.cast("int").alias("parts")).where("parts > 1")
    dealt = members.join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "block"), F.col("parts")).cast("int"))
    if not whole:
        return dealt.select(F.xxhash64("block", "part").alias("job"), "node", "root", F.lit(0).alias("side"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    job = F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return met.select(job.alias("job"), "node", "root", side.alias("side"))


def _pairs(members: DataFrame, kept: DataFrame, whole: bool, tile: int, limit: int) -> DataFrame:
    rows = _jobs(members, whole, limit).join(kept.select("node", "n", "bits"), "node").select("job", "node", "n", "root", "side", "bits")
    ordered = rows.repartition("job").sortWithinPartitions("job", "n", "node")
    return ordered.mapInArrow(_link_batches(whole, tile), "u bigint, v bigint, omitted bigint").distinct()


def frequent_shingles(docs: DataFrame, size: int = SHINGLE, keep: int = FREQUENT) -> np.ndarray:
    """Hash and place (from 1, rarest first) of at most ``keep`` shingles that most documents share, by hash.

    Counted over all documents, in which shared shingles meet a batch at a time. Where more shingles than
    ``keep`` are that frequent, whole levels of counts (four to a doubling) are left out, rarest first.
    """
    shared = docs.select("text").mapInArrow(_shared_batches(size), "shingle bigint, n bigint")
    counts = shared.groupBy("shingle").agg(F.sum("n").alias("n")).withColumn("level", F.floor(4 * F.log2("n")).cast("int"))
    counts = cut(counts, "shared")
    lowest, total = None, 0
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):  # a level per quarter of a doubling
        total += row["count"]
        if total > keep:
            break
        lowest = row["level"]
    found = counts.where(F.col("level") >= lowest).toPandas() if lowest is not None else counts.limit(0).toPandas()
    hashes = found.sort_values(["n", "shingle"])["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], order.astype(np.uint64) + np.uint64(1)], axis=1)


def fingerprint_pairs(kept: DataFrame) -> DataFrame:
    """``u, v`` of classes (``node, fp``) that connect whatever fingerprints within the radius of ``simhash`` connect.

    Every fingerprint is stood for by its smallest class, to which its other ones are paired.
    """
    first = kept.groupBy("fp").agg(F.min("node").alias("first"))
    same = kept.join(first, "fp").where("node > first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    linked = linked_fingerprints(first.select("fp")).distinct()
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("u", "v"))
    met = linked.join(left, "u").join(right, "v")
    return same.union(met.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, tile: int = TILE, keep: int = FREQUENT, bits: int = BITS, limit: int = BLOCK) -> DataFrame:
    """``doc_id, text_key, component_id`` of every document.

    Texts are lower-cased (A-Z) and cut at white space into shingles of ``size`` words; a shorter text is
    one shingle. Documents whose sets of shingles have a Jaccard similarity of ``SHARE`` or more are linked,
    null and texts without words with one another; ``component_id`` is the smallest doc_id reachable. Null
    ids are passed over by the minimum. An empty table gives an empty result; further columns are left aside.
    Intermediate tables are removed before this returns; the result itself is written.
    """
    with tables(docs.sparkSession):
        return cut(_near_duplicates(docs, size, tile, keep, bits, limit), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, size: int, tile: int, keep: int, bits: int, limit: int) -> DataFrame:
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size, keep))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_key bigint, node bigint, n bigint, fp bigint, bits binary, prefix array<bigint>"
    with tables(spark):
        sketched = cut(narrow.mapInArrow(_sketch_batches(frequent, size, bits), schema), "prefixes")
        sketches = cut(sketched.select("doc_id", "text_key", "node"), "sketches", keep=True)
        kept = cut(sketched.where("n > 0").dropDuplicates(["node"]).drop("doc_id", "prefix"), "sets", keep=True)
        listed = sketched.where("n > 0").select("node", "prefix").dropDuplicates(["node"]).select("node", F.explode("prefix").alias("shingle"))
        ordered = listed.repartition("shingle").sortWithinPartitions("shingle")
        members = cut(ordered.mapInArrow(_block_batches, "block bigint, node bigint").distinct(), "blocks", keep=True)

    def sets_of(nodes: DataFrame) -> DataFrame:
        # written, so that its size is known and the texts stay in place where it can be sent out
        keys = cut(kept.join(nodes.distinct(), "node", "left_semi").select("node", F.col("text_key").alias("_key")), "wanted")
        texts = narrow.join(keys, F.col("text_key") == F.col("_key")).select("node", "text")
        return texts.mapInArrow(_set_batches(size), "node bigint, shingles array<bigint>").dropDuplicates(["node"])

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")))
        left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        return pairs.join(left, "u").join(right, "v").where(similar(both, F.size("a"), F.size("b"))).select("u", "v")

    def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of members, with roots, of the blocks that lie in several components."""
        rows = rows.join(found, "node", "left").select("block", "node", F.coalesce("root", "node").alias("root"))
        apart = rows.groupBy("block").agg((F.min("root") < F.max("root")).alias("apart")).where("apart").select("block")
        return cut(rows.join(apart, "block", "left_semi"), "rooted")  # read twice, and large enough a plan

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        """The components that links between known ones make: of a star each, not of all links again."""
        stars = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
        return cut(components(stars.union(more)), "found")

    found = cut(components(verified(cut(fingerprint_pairs(kept), "pairs"))), "found")
    met = cut(_pairs(rooted(members, found), kept, False, tile, limit), "pairs")
    tried, omitted = met.where("omitted IS NULL").select("u", "v"), met.where("omitted IS NOT NULL").select(F.col("omitted").alias("job"))
    found = joined(found, verified(tried))
    large = cut(members.groupBy("block").count().where(F.col("count") > limit).select("block"), "large")
    if not large.isEmpty():
        one = rooted(members.join(large, "block", "left_semi"), found).groupBy("block", "root").agg(F.min("node").alias("node"))
        across = cut(_pairs(one, kept, False, tile, limit).where("omitted IS NULL").select("u", "v").join(tried, ["u", "v"], "left_anti"), "pairs")
        found = joined(found, verified(across))
    # of all other blocks every pair across the first components that may be similar is among those tried
    left_out = members.withColumn("job", F.xxhash64("block", F.lit(0))).join(omitted, "job", "left_semi").select("block", "node")
    again = left_out.union(members.join(large, "block", "left_semi").select("block", "node")).distinct()
    near = cut(_pairs(rooted(again, found), kept, True, tile, limit).where("omitted IS NULL").select("u", "v"), "pairs")
    if not near.isEmpty():
        clusters = cut(rooted(components(near).select(F.col("root").alias("block"), "node"), found), "clusters")
        shape = kept.select("node", "n", "bits")
        jobs = _jobs(clusters.join(kept.select("node", "n"), "node"), True, CLUSTER * limit // BLOCK or 1, ENTRIES)
        rows = jobs.join(shape, "node").join(sets_of(clusters.select("node")), "node")
        ordered = rows.repartition("job").sortWithinPartitions("job", "n", "node")
        found = joined(found, ordered.mapInArrow(_cluster_batches(tile), "u bigint, v bigint"))

    ids = sketches.groupBy("node").agg(F.min("doc_id").alias("first"))
    grouped = ids.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("node", "component_id")
    return sketches.select("doc_id", "text_key", "node").join(named, "node").drop("node")
