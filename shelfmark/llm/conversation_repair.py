"""Conversation structure repair: Knuth's lightest derivations over the rows of a conversation.

Roles should read ``(s?(ua)+)?`` by their initials.  Edits of a row: Keep (0), Rerole to user or assistant
(3), Delete (4, and required for blank and duplicate rows); Insert (3) puts an empty user or assistant row
anywhere; an undeleted truncated row adds 3.  An item ``(i, q)`` says: from row i on, with the grammar in
state q, the rest can be repaired.  Each edit is a deduction from a later item to an earlier one, the goal is
``(0, 0)``, and items are popped from an agenda by weight, so that the first pop of an item is final.

The weight is (cost, rows behind the item, audit), the audit being the initials of the edits from there on.
An edit puts its initial before an audit, so weights are monotone; without the count of rows in between Keep,
which costs nothing, would not be superior.  Of one item, equal costs differ in the first initial, as each edit has
one outcome: the least audit wins whatever follows.

Rows are dealt by ranges of (conversation, turn, role, digest of the text).  A conversation inside one range,
of at most ``PART_ROWS`` rows and about ``PART_BYTES``, is repaired where it stands.  Others are cut into
parts of that size: each part's lightest costs between states are found on their own, joined from the last part
backwards (a deduction from a part and the rest after it), and each part then finds its edits for that rest.
Only costs, states and audits of the parts of one conversation meet in one task, as a stream; last, the repaired
texts pass one digest per conversation, also as a stream, since sha256 has an order.

* Null role and null text: one space.  Null conversation ids are one conversation, null turns come first.
* Rows of one turn: by role, then sha256 of role and text.  Repeated rows are duplicates.
* A text without a character other than space and \\x09-\\x0D is blank, whatever its length; very long texts make a part of their own.
* No rows (or none present): zeros, an empty audit, the digest of an empty text.  An empty table: no rows.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import stored

PART_ROWS, PART_BYTES = 256, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}  # states: nothing, system, user, assistant
WANTED = ("user", "user", "assistant", "user")  # the role that may be put in each state
AFTER = (2, 2, 3, 2)
ENDS = (0, 3)
BEFORE = {q: [p for p in range(4) if AFTER[p] == q] for q in range(4)}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
EMPTY = hashlib.sha256(b"").hexdigest()

Weight = tuple[int, int, str]


def lightest(
    axioms: Iterable[tuple[Hashable, Weight]], deduce: Callable[[Hashable, Weight], Iterable[tuple[Hashable, Weight]]], goals: Iterable[Hashable],
) -> dict[Hashable, Weight]:
    """Weights of the items popped until all ``goals`` are final (or no item is left)."""
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Hashable, Weight] = {}
    open_goals = set(goals)
    while agenda and open_goals:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        open_goals.discard(item)
        for head, heavier in deduce(item, weight):
            if head not in final:
                heapq.heappush(agenda, (heavier, head))
    return final


def edits(initials: list[str], faults: str):
    """The deductions over some rows: ``initials`` of their roles, ``faults`` as b, d, t or - for each."""

    def deduce(item: tuple[int, int], weight: Weight) -> Iterator[tuple[tuple[int, int], Weight]]:
        (i, q), (cost, rows, audit) = item, weight
        for p in BEFORE[q]:
            yield (i, p), (cost + INSERT, rows, "I" + audit)
        if not i:
            return
        fault = faults[i - 1]
        yield (i - 1, q), (cost + DELETE, rows + 1, "D" + audit)
        if fault in "bd":
            return
        more = CUT_OFF if fault == "t" else 0
        for p in BEFORE[q]:
            yield (i - 1, p), (cost + REROLE + more, rows + 1, "R" + audit)
        for p in range(4):
            if NEXT.get((p, initials[i - 1])) == q:
                yield (i - 1, p), (cost + more, rows + 1, "K" + audit)

    return deduce


def replay(roles: list[str], texts: list[str], audit: str, state: int = 0) -> tuple[list[str], int]:
    """The repaired rows as ``role:text``, and the state after them."""
    lines, row = [], 0
    for edit in audit:
        if edit in "KRI":
            role = roles[row] if edit == "K" else WANTED[state]
            lines.append(f"{role}:{'' if edit == 'I' else texts[row]}")
            state = NEXT[state, role[:1]]
        row += edit != "I"
    return lines, state


def own_fault(text: str) -> str:
    solid = text.rstrip(SPACE)
    return "b" if not solid else "-" if solid[-1] in ".!?" else "t"


def _faults(texts: list[str], repeated: list[bool]) -> str:
    return "".join("d" if again and fault != "b" else fault for fault, again in zip(map(own_fault, texts), repeated))


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _initials(roles: list[str]) -> list[str]:
    return [role[:1] for role in roles]


def _spread(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """First, last and number of turns that are told."""
    told = [t for t in turns if t is not None]
    return (told[0], told[-1], len(set(told))) if told else (None, None, 0)


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return last - first + 1 - distinct if distinct else 0


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "part long, roles array<string>, texts array<string>, keys array<binary>, first long, last long, distinct long"


def _whole(roles: list[str], texts: list[str], keys: list[bytes], turns: list[int | None]) -> dict:
    seen: set[bytes] = set()
    repeated = [key in seen or seen.add(key) is not None for key in keys]
    initials, faults = _initials(roles), _faults(texts, repeated)
    n = len(roles)
    cost, _, audit = lightest([((n, q), (0, 0, "")) for q in ENDS], edits(initials, faults), [(0, 0)])[0, 0]
    lines, _ = replay(roles, texts, audit)
    return {
        "gaps": _gaps(*_spread(turns)), "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": _illegal(initials), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _part(number: int, roles: list[str], texts: list[str], keys: list[bytes], turns: list[int | None]) -> dict:
    seen: set[bytes] = set()
    new = [None if key in seen or seen.add(key) is not None else key for key in keys]  # null: repeats one of this part
    first, last, distinct = _spread(turns)
    return {"part": number, "roles": roles, "texts": texts, "keys": new, "first": first, "last": last, "distinct": distinct}


class _Batches:
    """Rows gathered into record batches of about a MB."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes > 1 << 20 or len(self.rows) >= 4096:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.bytes = [], 0


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch's rows may hold long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            yield from batch.slice(start, 64).to_pylist()


def _cut(rows: DataFrame, part_rows: int, part_bytes: int) -> DataFrame:
    """Sorted rows to results of whole conversations, and to parts of those that are long or cross a range."""
    out = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(f"{_PART}, {_RESULT}").fields])
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, number = _Batches(schema), TaskContext.get().partitionId() << 32
        roles, texts, keys, turns, size, cut, current, first = [], [], [], [], 0, False, None, True

        def close(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, roles, texts, keys, turns, size
            row = {"conv_id": current[0]}
            row |= _whole(roles, texts, keys, turns) if whole else _part(number, roles, texts, keys, turns)
            yield from gathered.add(row, 200 + (0 if whole else size))
            number += 1
            roles, texts, keys, turns, size = [], [], [], [], 0

        for row in _streamed(batches):
            conversation = (row["conv_id"],)
            if current != conversation:
                if current is not None:
                    yield from close(whole=not (first or cut))
                    first = False
                current, cut = conversation, False
            elif len(roles) >= part_rows or size >= part_bytes:
                yield from close(whole=False)
                cut = True
            if row["present"]:
                roles.append(row["role"])
                texts.append(row["text"])
                keys.append(row["key"])
                turns.append(row["turn"])
                size += len(row["text"]) + 80
        if current is not None:  # may go on in the next range
            yield from close(whole=False)
        yield from gathered.flush()

    return rows.mapInArrow(run, out)


# ---------------------------------------------------------------- conversations in several parts

def _mapped(df: DataFrame, schema: T.StructType, rows: Callable[[Iterator[dict]], Iterator[tuple[dict, int]]]) -> DataFrame:
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Batches(arrow)
        for row, size in rows(_streamed(batches)):
            yield from gathered.add(row, size)
        yield from gathered.flush()

    return df.mapInArrow(run, schema)


def _size(row: dict) -> int:
    return 200 + sum(map(len, row["texts"]))


def _costs(row: dict) -> dict:
    """A part's lightest costs from each state before it to each state after it."""
    again = set(row["again"] or ())
    faults = _faults(row["texts"], [key is None or at in again for at, key in enumerate(row["keys"])])
    initials = _initials(row["roles"])
    deduce, n, costs = edits(initials, faults), len(initials), []
    plain = lambda item, weight: [(head, (c, r, "")) for head, (c, r, _) in deduce(item, weight)]
    for q in range(4):
        final = lightest([((n, q), (0, 0, ""))], plain, [(0, p) for p in range(4)])
        costs.append([final[0, p][0] if (0, p) in final else None for p in range(4)])
    return {
        "conv_id": row["conv_id"], "part": row["part"], "roles": row["roles"], "texts": row["texts"], "faults": faults,
        "first": row["first"], "last": row["last"], "distinct": row["distinct"], "costs": [costs[q][p] for p in range(4) for q in range(4)],
    }


def _rests(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """Parts from the last to the first: the cost of what follows each, by the state after it."""
    conversation, rest = None, None
    for row in rows:
        if conversation != (row["conv_id"],):
            conversation, rest = (row["conv_id"],), [0 if q in ENDS else None for q in range(4)]
        yield {"part": row["part"], "rest": rest}, 60
        costs = row["costs"]
        rest = [min(costs[4 * p + q] + rest[q] for q in range(4) if None not in (costs[4 * p + q], rest[q])) for p in range(4)]


def _choices(row: dict) -> tuple[list[str], list[int]]:
    """The part's edits and the state after them, for each state before it."""
    initials, n = _initials(row["roles"]), len(row["roles"])
    axioms = [((n, q), (row["rest"][q], 0, "")) for q in range(4) if row["rest"][q] is not None]
    final = lightest(axioms, edits(initials, row["faults"]), [(0, p) for p in range(4)])
    audits = [final[0, p][2] for p in range(4)]
    return audits, [replay(row["roles"], row["texts"], audits[p], p)[1] for p in range(4)]


def _entries(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """Parts from the first to the last: the state before each."""
    conversation, state = None, 0
    for row in rows:
        if conversation != (row["conv_id"],):
            conversation, state = (row["conv_id"],), 0
        yield {"part": row["part"], "entry": state}, 40
        state = row["exits"][state]


def _assembled(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """Parts from the first to the last, as one result for each conversation."""
    def empty() -> dict:
        return {"digest": hashlib.sha256(), "some": False, "audit": [], "turns": None, "distinct": 0, "initial": None, "illegal": 0, "cost": 0, "b": 0, "d": 0, "t": 0}

    def result(conversation: tuple, s: dict) -> tuple[dict, int]:
        audit = "".join(s["audit"])
        first, last = s["turns"] or (None, None)
        return {
            "conv_id": conversation[0], "gaps": _gaps(first, last, s["distinct"]), "blank": s["b"], "duplicate": s["d"], "truncated": s["t"],
            "illegal": s["illegal"], "cost": s["cost"], "audit": audit, "repaired_sha256": s["digest"].hexdigest(),
        }, 200 + len(audit)

    conversation, s = None, empty()
    for row in rows:
        if conversation != (row["conv_id"],):
            if conversation is not None:
                yield result(conversation, s)
            conversation, s = (row["conv_id"],), empty()
        if row["lines"]:
            s["digest"].update((("\n" if s["some"] else "") + "\n".join(row["lines"])).encode())
            s["some"] = True
        s["audit"].append(row["audit"])
        s["cost"] += row["cost"]
        if row["distinct"]:
            same = s["turns"] is not None and s["turns"][1] == row["first"]
            s["distinct"] += row["distinct"] - same
            s["turns"] = (s["turns"][0] if s["turns"] else row["first"], row["last"])
        initials = row["initials"]
        if initials:
            s["illegal"] += _illegal(([s["initial"]] if s["initial"] is not None else []) + initials)
            s["initial"] = initials[-1]
        for fault in "bdt":
            s[fault] += row["faults"].count(fault)
    if conversation is not None:
        yield result(conversation, s)


def _audit_cost(faults: str, audit: str) -> int:
    cost, row = 0, 0
    for edit in audit:
        cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        cost += CUT_OFF if edit in "KR" and faults[row] == "t" else 0
        row += edit != "I"
    return cost


def _joined(parts: DataFrame) -> DataFrame:
    """Results of conversations in several parts."""
    kind = parts.schema["conv_id"]
    parse = lambda text: T.StructType([kind, *T._parse_datatype_string(text).fields])
    small = "first long, last long, distinct long"

    keys = parts.select("conv_id", "part", F.posexplode("keys").alias("at", "key")).where("key is not null")
    earliest = F.min("part").over(Window.partitionBy("conv_id", "key"))
    again = keys.withColumn("earliest", earliest).where("part > earliest").groupBy("part").agg(F.collect_list("at").alias("again"))  # of one part
    marked = _mapped(
        parts.join(again, "part", "left"), parse(f"part long, roles array<string>, texts array<string>, faults string, {small}, costs array<long>"),
        lambda rows: ((_costs(row), _size(row)) for row in rows))
    marked = stored(marked, "parts")

    def ordered(df: DataFrame, *order) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    rest_schema = T._parse_datatype_string("part long, rest array<long>")
    rests = _mapped(ordered(marked.select("conv_id", "part", "costs"), F.desc("part")), rest_schema, _rests)

    def chosen(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for row in rows:
            audits, exits = _choices(row)
            yield {"conv_id": row["conv_id"], "part": row["part"], "audits": audits, "exits": exits}, 200 + 4 * len(audits[0])

    choices = stored(_mapped(marked.drop("costs").join(rests, "part"), parse("part long, audits array<string>, exits array<int>"), chosen), "choices")
    entry_schema = T._parse_datatype_string("part long, entry int")
    entries = _mapped(ordered(choices.select("conv_id", "part", "exits"), "part"), entry_schema, _entries)
    picked = choices.join(entries, "part").select("part", "entry", F.element_at("audits", F.col("entry") + 1).alias("audit"))

    def repaired(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for row in rows:
            lines, _ = replay(row["roles"], row["texts"], row["audit"], row["entry"])
            same = {name: row[name] for name in ("conv_id", "part", "faults", "audit", "first", "last", "distinct")}
            yield same | {"initials": _initials(row["roles"]), "lines": lines, "cost": _audit_cost(row["faults"], row["audit"])}, _size(row)

    lines = _mapped(
        marked.drop("costs").join(picked, "part"),
        parse(f"part long, faults string, audit string, {small}, initials array<string>, lines array<string>, cost long"), repaired)
    return _mapped(ordered(lines, "part"), parse(_RESULT), _assembled)


def repair(conversations: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``.

    A boolean column ``present``, if there is one, tells which rows are there; others only name their conversation.
    """
    filled = [F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")]
    present = F.coalesce(F.col("present").cast("boolean"), F.lit(False)) if "present" in conversations.columns else F.lit(True)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, present.alias("present"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("key", digest)
    order = ["conv_id", "turn", "role", "key"]
    cut = stored(_cut(rows.repartitionByRange(*order).sortWithinPartitions(*order), part_rows, part_bytes), "conversations")
    results = [f.name for f in T._parse_datatype_string(_RESULT).fields]
    whole = cut.where("part is null").select("conv_id", *results)
    parts = cut.where("part is not null").select("conv_id", *[f.name for f in T._parse_datatype_string(_PART).fields])
    return whole.unionByName(_joined(parts).select("conv_id", *results))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) mod 20: 0 lost (not ``present``), 1 emptied, 2 without stops, 3 twice, 4 by the user."""
    filled = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"))
