"""Conversation repair against an exhaustive search over edits."""

import functools
import hashlib
import itertools
import random
import zlib

import pytest

from shelfmark.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part long, audit string"


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def slow(rows):
    """``(cost, audit, repaired)`` by trying every edit, with the whole audits compared."""
    faults = faults_of(rows)
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.lru_cache(None)
    def best(i, last, inserts):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts:
            for role in ("user", "assistant"):
                if role[0] in legal[last]:
                    cost, audit, lines = best(i, role[0], inserts - 1)
                    options.append((cost + 3, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, last, 2)
            options.append((cost + 4, "D" + audit, lines))
            if faults[i] not in "bd":
                late = 3 * (faults[i] == "t")
                for new, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new[:1] and new[:1] in legal[last]:
                        cost, audit, lines = best(i + 1, new[0], 2)
                        options.append((cost + price + late, edit + audit, (f"{new}:{text}", *lines)))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "", 2)


def expected(rows):
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (
        r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    told = [t for t, _, _ in rows if t is not None]
    faults = faults_of(rows)
    cost, audit, lines = slow(tuple(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(told) - min(told) + 1 - len(set(told)) if told else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(4)
    texts = ["One.", "Two?", "cut", "", " \t", "Fine! ", "end\x0b", "no stop\n", "x" * 5000 + ".", None, "日本。", "\xa0"]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    out = {}
    for k in range(150):
        n = rng.choice([1, 2, 3, 5, 8, 14])
        out[k] = [(rng.choice([None, *range(6)]) if k % 5 == 0 else t, rng.choice(roles[:3] if k % 3 else roles), rng.choice(texts)) for t in range(n)]
    out[None] = [(0, "user", "Hello."), (1, "assistant", "Hello.")]
    out[900] = [(t, "assistant" if t % 3 else "user", rng.choice(texts[:3]) + str(t // 7) + ".") for t in range(120)]
    return out


@pytest.mark.parametrize("part_rows,part_bytes", [(256, 1 << 20), (2, 1 << 20), (7, 300)])
def test_repair(spark, part_rows, part_bytes):
    told = conversations()
    rows = [(c, t, r, x, "c", 1, "a") for c, each in told.items() for t, r, x in each]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df, part_rows, part_bytes).collect()}
    assert got == {c: expected(each) for c, each in told.items()}


def test_hot_conversation_over_many_ranges(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"Text {t % 50}.", "c", 1, "a") for t in range(900)] + [(k, 0, "user", "Hi.", "c", 1, "a") for k in range(5)]
    whole = C._whole([r[2] for r in rows[:900]], [r[3] for r in rows[:900]], [f"{r[2]}{r[3]}".encode() for r in rows[:900]], list(range(900)))
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(spark.createDataFrame(rows, SCHEMA).repartition(8), part_rows=32).collect()}
    assert got.pop(5) == tuple(whole.values())
    assert got == {k: expected([(0, "user", "Hi.")]) for k in range(5)}


def test_damage(spark):
    rows = [(c, t, ["user", "assistant", "system", None][(c or 0) % 4], "A. b! c?" if t != 3 else None) for c in [*range(40), None] for t in [0, 1, 3, None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, t, role, text in rows:
        blank = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        each = want.setdefault(c, [])
        each += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(C.damage(df)).collect()}
    assert got == {c: expected(each) if each else (0, 0, 0, 0, 0, 0, "", C.EMPTY) for c, each in want.items()}


def test_lost_conversations_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", False), (2, None, None, None, True)], "conv_id long, turn long, role string, text string, present boolean")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", C.EMPTY), 2: (0, 1, 0, 0, 0, 4, "D", C.EMPTY)}
    assert C.repair(df.limit(0)).count() == 0
    assert C.repair(C.damage(df.limit(0))).count() == 0
