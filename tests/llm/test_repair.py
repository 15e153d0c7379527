"""Repairs against an exhaustive search over edit sequences, and blocks against whole conversations."""

import functools
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair as rp

SPACE = " \t\n\x0b\x0c\r"


def search(rows):
    """(cost, audit) by trying all edits; rows are (initial, fault)."""

    @functools.cache
    def plain(i, built, level):
        found = []
        if i == len(rows):
            if built == "" or built == "a":
                found.append((0, ""))
        else:
            initial, fault = rows[i]
            cost, rest = plain(i + 1, built, 0)
            found.append((cost + 4, "D" + rest))
            if fault != "d":
                more = 3 if fault == "t" else 0
                if fits(built, initial):
                    cost, rest = plain(i + 1, (built + initial)[-1:], 0)
                    found.append((cost + more, "K" + rest))
                for c in "ua":
                    if fits(built, c):
                        cost, rest = plain(i + 1, (built + c)[-1:], 0)
                        found.append((cost + more + 3, "R" + rest))
        if level < 4:  # more insertions in a row than can pay
            for c in "ua":
                if fits(built, c):
                    cost, rest = plain(i, (built + c)[-1:], level + 1)
                    found.append((cost + 3, "I" + rest))
        return min(found, default=(1 << 40, ""))

    return plain(0, "", 0)


def fits(built, c):
    return (built[-1:], c) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}


def brute(rows, every=()):
    """Expected result per conversation for rows (conv_id, turn, role, text) after damage."""
    convs = {c: [] for c in every}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0], r[1], r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, coded, n = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
        for _, _, role, text in held:
            bare = text.strip(SPACE)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            coded.append((role[:1], "d" if fault == "b" else fault))
        turns = [t for known, t, _, _ in held if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        cost, audit = search(tuple(coded))
        lines, state, rest = [], "", iter(held)
        for letter in audit:
            row = next(rest) if letter != "I" else None
            if letter == "D":
                continue
            state = row[2][:1] if letter == "K" else "a" if state == "u" else "u"
            role = row[2] if letter == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{row[3] if row else ''}")
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def corpus(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why?  ", "cut off", "", " \n", None, "é.", "Again.", f"t{turn}."])
            rows += [(conv, rng.choice([turn, turn, turn, turn + 3, None, -turn]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_search(spark):
    rows = corpus(150, 1) + [(None, 1, "user", "Hi."), (None, None, "system", "Be good.")]
    want = brute(rows)
    assert {len(set(w[6])) for w in want.values()} >= {1, 2, 3}
    assert found(rp.repair(spark.createDataFrame(rows, SCHEMA))) == want


def test_long_conversations_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp, "BLOCK", 3)
    rng = random.Random(5)
    rows = corpus(30, 2) + [(99, t, rng.choice(["user", "assistant", "user", "tool"]), f"{rng.randrange(500)}{rng.choice('..?x')}") for t in range(700)]
    rows += [(98, None, rng.choice(["user", "assistant"]), f"{i}.") for i in range(150)] + [(97, 4, "user", "same.")] * 300
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    held = rp.blocks(rp.faults(rp.turns_of(df))).where("conv = '{\"id\":99}'").collect()
    assert 20 <= len(held) <= 300 and sum(len(r["rows"]) for r in held) == 700
    assert found(rp.repair(df)) == want


def test_repaired_turns_follow_the_pattern(spark):
    rows = corpus(60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    digests = {c: v[-1] for c, v in found(rp.repair(df)).items()}
    convs = {c: [] for c in digests}
    for r in rp.repaired_turns(df).orderBy("conv_id", "position").collect():
        assert r["position"] == len(convs[r["conv_id"]])
        convs[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, lines in convs.items():
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digests[conv]
        roles = "".join(line[:1] for line in lines).removeprefix("s" if len(lines) > 1 else "")
        assert roles == "ua" * (len(roles) // 2)


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = corpus(400, 4, 3)
    want_rows = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        want_rows += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(repr, (tuple(r) for r in rp.damage(df).collect()))) == sorted(map(repr, want_rows))
    want = brute(want_rows, range(400))
    empty = hashlib.sha256(b"").hexdigest()
    assert (0, 0, 0, 0, 0, 0, "", empty) in want.values()
    assert found(rp.repair(rp.damage(df), df)) == want


def test_empty_table_and_clashing_columns(spark):
    schema = SCHEMA + ", conv string, block int, n int, audit string, md5 string"
    assert found(rp.repair(spark.createDataFrame([], schema))) == {}
    rows = corpus(20, 6)
    df = spark.createDataFrame([(*r, "x", 1, 2, "K", "z") for r in rows], schema)
    assert found(rp.repair(df)) == brute(rows)
    assert found(rp.repair(rp.damage(df), df)).keys() == {r[0] for r in rows}


ROW = st.tuples(st.sampled_from("suax"), st.sampled_from(["", "t", "d"]), st.integers(1, 2))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=8), st.integers(1, 4))
def test_blocks_give_the_walk_of_the_whole(rows, size):
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    ends = rp.checkpoints([rp.transfer(p) for p in parts])
    state, audit = rp.START, ""
    for part, behind in zip(parts, ends[1:]):
        state, letters = rp.walk(part, behind, state)
        audit += letters
    plain = tuple((c, "d" if k else f) for c, f, n in rows for k in range(n))
    assert (ends[0][rp.START], audit + rp.ending(state)) == search(plain)


def test_empty_program():
    assert rp.checkpoints([]) == [list(rp.END)] and rp.END[rp.START] == 0
