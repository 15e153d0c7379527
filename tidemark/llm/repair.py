"""Conversation structure repair: the cheapest edits after which the roles read ``(s?(ua)+)?``.

Every row is kept (free), given the role that is due (``REROLE``) or deleted (``DELETE``; blank and repeated rows
must be), and empty turns may be put in (``INSERT``); a truncated row that stays costs ``TRUNCATED`` more. The
dynamic program runs backward over a conversation: a vector holds, for each of four states of the role
pattern, the least cost of what follows. Of the tight edit sequences the one whose initials come first in
ASCII is read off forward.

Vectors are stored at checkpoints only. A conversation of n rows is cut into blocks of about the square root
of n rows. Each block alone, in any task, gives the least costs from state to state as a small matrix (least
sums in place of products). Per conversation these matrices, about a square root of n, give the vectors at the block ends. Walking forward, each
block computes its own vectors again from the one at its end, and the walks of the blocks are joined by
their states. No task holds the vectors of more than a block.

Rows of a conversation are ordered by turn (null first), then role, then the MD5 of the text. The order is made by a
range partitioning of narrow rows, so a conversation of any length is spread; equal rows are counted, not
repeated. Texts move once, to be read in order by the task that writes or hashes their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import type_of
from tidemark.plans.scratch import cut

#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Least rows of a block; more where the square root of the conversation's rows is more.
BLOCK = 64
#: White space: the characters that do not make a text.
SPACE = " \t\n\x0b\f\r"

#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that is due (user, but assistant after user).
DUE = (USER, USER, ASSISTANT, USER)
#: The state after keeping a role, by its initial; a pair not listed is against the pattern.
KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost of what follows the last row: the pattern may end after an assistant turn, or be empty.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60

#: A row in the program: (initial, fault, copies), faults being "" (none), "t" (truncated) and "d" (must go).
Row = tuple[str, str, int]


def with_insertions(costs: list[int]) -> list[int]:
    """Costs where up to two turns may be put in first (a third never helps)."""
    return [min(costs[s], INSERT + costs[DUE[s]], 2 * INSERT + costs[DUE[DUE[s]]]) for s in range(4)]


def before(row: Row, after: list[int]) -> list[int]:
    """Costs in front of a row, given those behind it; further copies of a row are repeated, so they go."""
    initial, fault, copies = row
    after = [c + DELETE * (copies - 1) for c in after]
    costs = [c + DELETE for c in after]
    if fault != "d":
        stay = TRUNCATED if fault == "t" else 0
        for s in range(4):
            costs[s] = min(costs[s], stay + REROLE + after[DUE[s]])
            if (initial, s) in KEEP:
                costs[s] = min(costs[s], stay + after[KEEP[initial, s]])
    return [min(c, FAR) for c in with_insertions(costs)]


def transfer(rows: list[Row]) -> list[int]:
    """Least costs of a block from state to state, as 16 numbers."""
    columns = []
    for end in range(4):
        costs = [0 if s == end else FAR for s in range(4)]
        for row in reversed(rows):
            costs = before(row, costs)
        columns.append(costs)
    return [columns[end][s] for s in range(4) for end in range(4)]


def checkpoints(matrices: list[list[int]]) -> list[list[int]]:
    """Costs in front of the first block and behind each block of a conversation."""
    found = [list(END)]
    for m in reversed(matrices):
        found.append([min(min(m[4 * s + e] + found[-1][e] for e in range(4)), FAR) for s in range(4)])
    return found[::-1]


def walk(rows: list[Row], behind: list[int], state: int) -> tuple[int, str]:
    """The state behind a block and the initials of its edits, ASCII-least among the tight ones.

    The block's vectors are computed again from the one behind it. D comes before I, K and R, and each letter
    leads to one state only, so taking the least tight letter at every step gives the least sequence.
    """
    vectors = [behind]
    for row in reversed(rows):
        vectors.append(before(row, vectors[-1]))
    vectors.reverse()
    letters = []
    for i, (initial, fault, copies) in enumerate(rows):
        after = [c + DELETE * (copies - 1) for c in vectors[i + 1]]
        while True:
            now = vectors[i][state]
            if DELETE + after[state] == now:
                letters.append("D")
                break
            if INSERT + vectors[i][DUE[state]] == now:
                letters.append("I")
                state = DUE[state]
                continue
            kept = KEEP.get((initial, state))
            if kept is not None and (TRUNCATED if fault == "t" else 0) + after[kept] == now:
                letters.append("K")
                state = kept
            else:
                letters.append("R")
                state = DUE[state]
            break
        letters.append("D" * (copies - 1))
    return state, "".join(letters)


def ending(state: int) -> str:
    """The turns put in behind the last row."""
    return "I" * (END[state] // INSERT)


def _key(conv_id: Column) -> Column:
    """A text for a conversation, also for null."""
    return F.to_json(F.struct(conv_id.alias("id")))


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def turns_of(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` of a table with ``conv_id``; null roles and texts are one space."""
    return turns.select(
        _key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )


def faults(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, md5, copies, fault`` of equal rows, with the fault of the first of them: b blank, d repeated
    (role and text stand in an earlier turn), t truncated, else empty."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    narrow = rows.select("conv", "turn", "role", F.md5("text").alias("md5"), last.alias("last"))
    counted = narrow.groupBy("conv", "turn", "role", "md5").agg(F.count("*").alias("copies"), F.first("last").alias("last"))
    earliest = counted.groupBy("conv", "role", "md5").agg(F.min(F.struct("turn")).alias("earliest"))
    known = counted.join(earliest, ["conv", "role", "md5"])
    first = F.col("turn").eqNullSafe(F.col("earliest.turn"))
    fault = F.when(F.col("last") == "", "b").when(~first, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("")
    return known.select("conv", "turn", "role", "md5", "copies", fault.alias("fault"))


def counts(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated`` of the rows that ``faults`` gives."""
    n, fault = F.col("copies"), F.col("fault")
    # copies of a blank row are blank, copies of any other are repeated
    a_turn = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(fault == "b", n).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "b", 0).when(fault == "d", n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(fault == "t", 1).otherwise(0)).alias("truncated"),
    )
    wide = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")]
    return a_turn.groupBy("conv").agg(F.coalesce(wide, F.lit(0)).cast("bigint").alias("gaps"), *sums)


def blocks(rows: DataFrame) -> DataFrame:
    """``conv, block, rows`` with the rows of each block in order, from the rows that ``faults`` gives."""
    order = ["turn", "role", "md5"]
    code = F.when(F.col("fault").isin("b", "d"), "d").otherwise(F.col("fault"))
    slim = rows.select("conv", *order, _initial(F.col("role")).alias("initial"), code.alias("fault"), "copies")
    spread = cut(slim.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "ordered")
    across = Window.partitionBy("conv")
    upto = across.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("conv", "part").agg(F.count("*").alias("m"))
    offsets = sizes.select("conv", "part", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("ahead"), F.sum("m").over(across).alias("size"))
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    placed = spread.withColumn("i", F.row_number().over(inside)).join(offsets, ["conv", "part"]).withColumn("i", F.col("i") + F.col("ahead") - 1)
    wide = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("size")))
    numbered = placed.withColumn("block", F.floor(F.col("i") / wide))
    held = F.sort_array(F.collect_list(F.struct("i", "initial", "fault", "copies")))
    return numbered.groupBy("conv", "block").agg(held.alias("rows"))


def _rows_of(batch: pa.RecordBatch) -> list[list[Row]]:
    return [[(r["initial"], r["fault"], r["copies"]) for r in rows] for rows in batch.column("rows").to_pylist()]


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def _transfer_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        held = _rows_of(batch)
        illegal = [sum(r[2] - 1 for r in rows) + sum(not legal(a[0], b[0]) for a, b in zip(rows, rows[1:])) for rows in held]
        yield _batch({
            "conv": batch.column("conv"), "block": batch.column("block"), "costs": pa.array([transfer(r) for r in held], pa.list_(pa.int64())),
            "illegal": pa.array(illegal, pa.int64()), "head": pa.array([r[0][0] for r in held], pa.string()), "tail": pa.array([r[-1][0] for r in held], pa.string()),
        })


def _checkpoint_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        costs, illegal, behind = [], [], []
        for steps in batch.column("steps").to_pylist():
            found = checkpoints([s["costs"] for s in steps])
            costs.append(found[0][START])
            illegal.append(sum(s["illegal"] for s in steps) + sum(not legal(a["tail"], b["head"]) for a, b in zip(steps, steps[1:])))
            behind.append([{"block": s["block"], "behind": v} for s, v in zip(steps, found[1:])])
        kind = pa.list_(pa.struct([("block", pa.int64()), ("behind", pa.list_(pa.int64()))]))
        yield _batch({"conv": batch.column("conv"), "cost": pa.array(costs, pa.int64()), "illegal": pa.array(illegal, pa.int64()), "ends": pa.array(behind, kind)})


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        states, letters = [], []
        for rows, behind, block in zip(_rows_of(batch), batch.column("behind").to_pylist(), batch.column("block").to_pylist()):
            # the first block is entered in one state only
            walked = [walk(rows, behind, s) for s in (range(4) if block else (START,))]
            states.append([w[0] for w in walked])
            letters.append([w[1] for w in walked])
        yield _batch({"conv": batch.column("conv"), "block": batch.column("block"), "states": pa.array(states, pa.list_(pa.int32())), "letters": pa.array(letters, pa.list_(pa.string()))})


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        audits = []
        for steps in batch.column("steps").to_pylist():
            state, parts = START, []
            for step in steps:
                parts.append(step["letters"][state])
                state = step["states"][state]
            audits.append("".join(parts) + ending(state))
        yield _batch({"conv": batch.column("conv"), "audit": pa.array(audits, pa.string())})


def audits(rows: DataFrame) -> DataFrame:
    """``conv, cost, illegal, audit`` of the conversations whose rows ``faults`` gives."""
    held = cut(blocks(rows), "blocks")
    steps = held.mapInArrow(_transfer_batches, "conv string, block bigint, costs array<bigint>, illegal bigint, head string, tail string")

    def in_order(df: DataFrame) -> DataFrame:
        return df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", *[c for c in df.columns if c not in ("conv", "block")]))).alias("steps"))

    checked = cut(in_order(steps).mapInArrow(_checkpoint_batches, "conv string, cost bigint, illegal bigint, ends array<struct<block:bigint,behind:array<bigint>>>"), "checkpoints")
    ends = checked.select("conv", F.inline("ends"))
    walked = held.join(ends, ["conv", "block"]).mapInArrow(_walk_batches, "conv string, block bigint, states array<int>, letters array<string>")
    audit = in_order(walked).mapInArrow(_audit_batches, "conv string, audit string")
    return checked.select("conv", "cost", "illegal").join(audit, "conv")


def _in_order(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation in one partition: its audit, then its rows in order."""
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("md5"), "text")
    marks = audited.select("conv", F.lit(0), F.lit(None).cast(type_of(rows, "turn")), F.lit(""), F.lit(""), "audit")
    return marks.union(texts).toDF("conv", "kind", "turn", "role", "md5", "text").repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "md5")


class _Replay:
    """Reads a conversation's audit and rows, and gives the edited turns one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = DUE[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[role[:1], self.state]
            yield "K", role, text
        elif letter == "R":
            self.state = DUE[self.state]
            yield "R", ROLES[self.state], text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str, str]]:
    """(conversation, letter, role, text) of the repaired turns, and letter None where a conversation ends."""
    conv, replayed = None, None
    for batch in batches:
        for now, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
            if kind == 0:
                if replayed:
                    yield from ((conv, *e) for e in replayed.insertions())
                    yield conv, None, "", ""
                conv, replayed = now, _Replay(text)
            else:
                yield from ((conv, *e) for e in replayed.row(role, text))
    if replayed:
        yield from ((conv, *e) for e in replayed.insertions())
        yield conv, None, "", ""


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    done, running, begun = [], hashlib.sha256(), False
    for conv, letter, role, text in _edited(batches):
        if letter is None:
            done.append((conv, running.hexdigest()))
            running, begun = hashlib.sha256(), False
            if len(done) == 10_000:
                yield _batch({"conv": pa.array([d[0] for d in done]), "repaired_sha256": pa.array([d[1] for d in done])})
                done = []
        else:
            running.update((("\n" if begun else "") + f"{role}:{text}").encode())
            begun = True
    if done:
        yield _batch({"conv": pa.array([d[0] for d in done]), "repaired_sha256": pa.array([d[1] for d in done])})


def _turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held, size, place, last = [], 0, 0, None
    names = ("conv", "position", "edit", "role", "text")

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return _batch({name: pa.array([h[k] for h in held], kinds[k]) for k, name in enumerate(names)})

    for conv, letter, role, text in _edited(batches):
        place = 0 if conv != last else place
        last = conv
        if letter is None:
            last = None
            continue
        held.append((conv, place, letter, role, text))
        place, size = place + 1, size + len(text)
        if len(held) == 10_000 or size > 1 << 22:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text`` of the repaired conversations; see ``repair`` for the rules."""
    rows = turns_of(turns)
    found = _in_order(rows, audits(cut(faults(rows), "faults")))
    edited = found.mapInArrow(_turn_batches, "conv string, position bigint, edit string, role string, text string")
    back = F.from_json("conv", f"struct<id:{type_of(turns, 'conv_id')}>")["id"]
    return edited.select(back.alias("conv_id"), "position", "edit", "role", "text")


def repair(turns: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, text``): its faults and its repair.

    ``gaps`` (missing turns between the first and the last, nulls ignored), ``blank``, ``duplicate``, ``truncated``
    (rows by their first fault), ``illegal`` (adjacent role initials other than su, ua, au), ``cost`` of the cheapest
    edits, their initials ``audit``, and ``repaired_sha256`` of the repaired ``role:text`` lines.

    Null roles and texts are one space; a role that is empty fits nowhere. A null ``conv_id`` is a conversation of its own. Rows of one turn
    are ordered by role and the MD5 of the text; equal rows repeat each other. Conversations that only ``all_ids``
    has (by default none) have zeros and empty repairs. Other columns are left aside; an empty table gives no
    rows. The digest of a conversation is one chain, so one task reads its texts, as a stream.
    """
    rows = turns_of(turns)
    found = cut(faults(rows), "faults")
    audited = cut(audits(found), "audits")
    digests = _in_order(rows, audited.select("conv", "audit")).mapInArrow(_digest_batches, "conv string, repaired_sha256 string")
    ids = (all_ids if all_ids is not None else turns).select("conv_id", _key(F.col("conv_id")).alias("conv")).distinct()
    joined = ids.join(counts(found), "conv", "left").join(audited, "conv", "left").join(digests, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 as user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    marked = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")
