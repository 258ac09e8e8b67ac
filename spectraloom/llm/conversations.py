"""Repair of conversations: cheapest edits that leave a system turn at most, then user and assistant by turns.

Every turn becomes a symbol of its role and its first fault. Over all symbol sequences Re-Pair finds a grammar, whose rules
stand for pairs that occur often, and each rule gets one min-plus transfer matrix: for each pair of states of the wanted form
the least cost of leading from one to the other, with a rope of the edits. Matrices are evaluated bottom-up, once, and shared
by all conversations; a conversation is the product of the few matrices of its compressed sequence.

A conversation is one of many rows of a sorted table: a long one spreads over tasks, which turn their stretches into
matrices, and only these meet. What one conversation's row must hold, its audit, bounds its length: some 10^8 turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.plans.lineage import cut

WHITE = " \t\n\x0b\x0c\r"
#: Symbols of a stretch at most; longer conversations are cut into several.
STRETCH = 4096
#: Rules of a grammar and rounds of counting pairs at most. Fewer rules mean longer products, not other results.
RULES, ROUNDS = 1024, 12
#: Evaluated sequences a task remembers before it forgets all.
REMEMBERED = 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
ROLES = "sua"
#: States of what is written so far: nothing, after the system turn, after a user turn, after an assistant turn.
STATES, START, ENDS = 4, 0, (0, 3)
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
LEGAL = {"su", "ua", "au"}
TERMINALS = [chr(ord("A") + i) for i in range(16)]
FIRST_RULE = 0x100


# ---- ropes and matrices ------------------------------------------------------------------------------------------


class Rope:
    """A text that shares its parts with others; written out only in the end."""

    __slots__ = ("text", "parts")

    def __init__(self, text: str | None = None, parts: tuple[Rope, Rope] | None = None):
        self.text, self.parts = text, parts

    def __add__(self, other: Rope) -> Rope:
        if self.text == "" or other.text == "":
            return other if self.text == "" else self
        return Rope(parts=(self, other))

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            rope = waiting.pop()
            if rope.text is None:
                waiting += rope.parts[::-1]
            else:
                yield rope.text

    def __str__(self) -> str:
        if self.text is None:
            self.text, self.parts = "".join(self.leaves()), None
        return self.text


#: A matrix: for each pair of states (from, to) the least cost and its edits, or None.
Cell = tuple[int, Rope] | None
Matrix = tuple[tuple[Cell, ...], ...]


def better(a: Cell, b: Cell) -> Cell:
    """The cheaper one; of equally cheap ones that with the lesser text. Edits of one stretch that cost the same are never
    the beginning of one another, so the order stays whatever follows."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or str(a[1]) <= str(b[1]) else b


def times(a: Matrix, b: Matrix) -> Matrix:
    def cell(p: int, q: int) -> Cell:
        ways = [(x[0] + y[0], x[1] + y[1]) for m in range(STATES) if (x := a[p][m]) and (y := b[m][q])]
        return reduce(better, ways, None)

    return tuple(tuple(cell(p, q) for q in range(STATES)) for p in range(STATES))


def matrix_of(ways: list[tuple[int, int, int, str]]) -> Matrix:
    rows: list[list[Cell]] = [[None] * STATES for _ in range(STATES)]
    for p, q, cost, edit in ways:
        rows[p][q] = better(rows[p][q], (cost, Rope(edit)))
    return tuple(map(tuple, rows))


NOTHING = matrix_of([(p, p, 0, "") for p in range(STATES)])
ONE_MORE = matrix_of([(p, NEXT[p][r], INSERT, "I") for p in NEXT for r in "ua" if r in NEXT[p]])
#: Up to two inserted turns; more never pay, as two return to the state they began in.
INSERTED = tuple(tuple(reduce(better, cells) for cells in zip(*rows)) for rows in zip(NOTHING, ONE_MORE, times(ONE_MORE, ONE_MORE)))


def edits(symbol: str) -> Matrix:
    """What may be inserted before a turn and done with it."""
    role, fault = divmod(TERMINALS.index(symbol), 4)
    ways = [(p, p, DELETE, "D") for p in range(STATES)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for p, follows in NEXT.items():
            for letter, q in follows.items():
                if role < len(ROLES) and letter == ROLES[role]:
                    ways.append((p, q, KEEP + extra, "K"))
                if letter != "s":
                    ways.append((p, q, REROLE + extra, "R"))
    return times(INSERTED, matrix_of(ways))


@dataclass(frozen=True)
class Summary:
    """What a stretch of turns adds to its conversation."""

    matrix: Matrix = NOTHING
    faults: tuple[int, int, int] = (0, 0, 0)
    illegal: int = 0
    ends: tuple[str, str] | None = None

    def then(self, other: Summary) -> Summary:
        faults = tuple(a + b for a, b in zip(self.faults, other.faults))
        if self.ends is None or other.ends is None:
            return Summary(times(self.matrix, other.matrix), faults, self.illegal + other.illegal, self.ends or other.ends)
        seam = int(self.ends[1] + other.ends[0] not in LEGAL)
        return Summary(times(self.matrix, other.matrix), faults, self.illegal + other.illegal + seam, (self.ends[0], other.ends[1]))

    @classmethod
    def of(cls, symbol: str) -> Summary:
        role, fault = divmod(TERMINALS.index(symbol), 4)
        letter = (ROLES + "o")[role]
        return cls(edits(symbol), tuple(int(fault == f) for f in (BLANK, DUPLICATE, CUT)), 0, (letter, letter))


@dataclass
class Grammar:
    """Rules in the order they were found: each is a pair of earlier symbols, written one after the other."""

    rules: list[str] = field(default_factory=list)

    @staticmethod
    def name(number: int) -> str:
        return chr(FIRST_RULE + number)

    def compressed(self, symbols: str) -> str:
        for number, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, self.name(number))
        return symbols

    def summaries(self) -> dict[str, Summary]:
        """One for every symbol, from the terminals up."""
        found = {symbol: Summary.of(symbol) for symbol in TERMINALS}
        for number, (left, right) in enumerate(self.rules):
            found[self.name(number)] = found[left].then(found[right])
        return found


def learn_grammar(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over ``symbols`` with weights ``n``: the most frequent pairs become rules, until none occurs twice.

    A round counts all pairs in all sequences; it takes the most frequent one, and after it those that share no symbol with
    one taken, whose counts are therefore still right. The driver gets a bounded number of pairs, never sequences.
    """
    grammar, text = Grammar(), F.col("symbols")
    for _ in range(rounds):
        places = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
        pairs = sequences.select(F.explode(places).alias("at"), text.alias("text"), "n").select(F.col("text").substr(F.col("at"), F.lit(2)).alias("pair"), "n")
        counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect()
        taken: set[str] = set()
        for row in counted:
            if not taken & set(row.pair) and len(grammar.rules) < rules:
                taken |= set(row.pair)
                text = F.replace(text, F.lit(row.pair), F.lit(grammar.name(len(grammar.rules))))
                grammar.rules.append(row.pair)
        if not taken or len(grammar.rules) == rules:
            break
    return grammar


# ---- turns to stretches ------------------------------------------------------------------------------------------


def turn_rows(turns: DataFrame, conversation: str, turn: str, role: str, text: str, copies: Column) -> DataFrame:
    """``conv, turn, role, digest, text, kind, copies``: NULL roles and texts are one space; ``kind`` is the role's and fault's
    number, duplicates not told yet."""
    said, by = F.coalesce(turns[text].cast("string"), F.lit(" ")), F.coalesce(turns[role].cast("string"), F.lit(" "))
    ink = F.rtrim(said, F.lit(WHITE))
    fault = F.when(ink == "", BLANK).when(F.right(ink, F.lit(1)).isin(*".!?"), FINE).otherwise(CUT)
    place = F.instr(F.lit(ROLES), F.left(by, F.lit(1)))
    number = F.when((place == 0) | (by == ""), len(ROLES)).otherwise(place - 1)
    return turns.select(
        turns[conversation].alias("conv"), turns[turn].cast("long").alias("turn"), by.alias("role"), F.unhex(F.sha2(said, 256)).alias("digest"),
        said.alias("text"), (number * 4 + fault).cast("int").alias("kind"), copies.cast("long").alias("copies"),
    )


ORDER = ["conv", "late", "turn", "role", "digest"]


def in_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("late", F.col("turn").isNotNull())


def told_apart(rows: DataFrame) -> DataFrame:
    """Turns without texts, equal ones of a place as one row: ``first`` tells those whose role and text were not seen earlier.

    The earliest place of each role and text is found by aggregation and joined with the place as a part of the key, so no
    key has more rows than one.
    """
    keys = ["conv", "role", "digest"]
    places = cut(rows.groupBy("conv", "turn", "role", "digest", "kind").agg(F.sum("copies").alias("copies")))
    places = in_order(places)
    early = places.where("copies > 0").groupBy(*keys).agg(F.min(F.struct("late", "turn")).alias("place"))
    early = early.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("place.turn").alias("turn_"), F.lit(True).alias("first"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, "turn")])
    return places.join(early, same, "left").select(*ORDER, "kind", "copies", F.coalesce("first", F.lit(False)).alias("first"))


STRETCHES = "part int, number int, symbols string, lo long, hi long, turns long"


def runs(kind: int, first: bool, copies: int) -> Iterator[tuple[str, int]]:
    """The symbols of equal turns in one place, with their numbers."""
    role, fault = divmod(kind, 4)
    again = TERMINALS[role * 4 + (BLANK if fault == BLANK else DUPLICATE)]
    if first and copies:
        yield TERMINALS[kind], 1
    if copies > first:
        yield again, copies - first


def stretched(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to stretches: those of one conversation, at most ``limit`` symbols in each."""
    from pyspark import TaskContext

    part, numbers, kind = TaskContext.get().partitionId(), count(), None
    rows: list[tuple] = []
    conv, symbols, filled, lo, hi, turns, open_ = None, [], 0, None, None, 0, False

    def flush() -> None:
        rows.append((conv, part, next(numbers), "".join(symbols), lo, hi, turns))

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, turn, k, copies, first in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if not open_ or c != conv:
                if open_:
                    flush()
                conv, symbols, filled, lo, hi, turns, open_ = c, [], 0, None, None, 0, True
            for symbol, left in runs(k, first, copies):
                while left:
                    if filled == limit:
                        flush()
                        symbols, filled, lo, hi, turns = [], 0, None, None, 0
                    taken = min(left, limit - filled)
                    symbols.append(symbol * taken)
                    filled, left = filled + taken, left - taken
                    if turn is not None and turn != hi:
                        lo, hi, turns = turn if lo is None else lo, turn, turns + 1
            if len(rows) >= 5000:
                yield batch_of(rows, kind)
                rows.clear()
    if open_:
        flush()
    if rows:
        yield batch_of(rows, kind)


def batch_of(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv", *(c.split()[0] for c in STRETCHES.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def stretches(places: DataFrame, limit: int = STRETCH) -> DataFrame:
    """``conv, part, number, symbols, lo, hi, turns``: by part and number, a conversation's stretches in order, with the least
    and the greatest turn number of each and how many there are."""
    kind = places.schema["conv"].dataType.simpleString()
    ordered = places.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv", "turn", "kind", "copies", "first")
    return ordered.mapInArrow(lambda batches: stretched(batches, limit), f"conv {kind}, {STRETCHES}")


# ---- evaluation --------------------------------------------------------------------------------------------------

SUMMARY = "struct<costs:array<bigint>,audits:array<string>,faults:array<bigint>,illegal:bigint,ends:string>"


def packed(s: Summary) -> dict:
    cells = [cell for row in s.matrix for cell in row]
    return {
        "costs": [None if c is None else c[0] for c in cells],
        "audits": [None if c is None else str(c[1]) for c in cells],
        "faults": list(s.faults),
        "illegal": s.illegal,
        "ends": None if s.ends is None else "".join(s.ends),
    }


def unpacked(s: dict) -> Summary:
    cells = [None if c is None else (c, Rope(a)) for c, a in zip(s["costs"], s["audits"])]
    matrix = tuple(tuple(cells[p * STATES : (p + 1) * STATES]) for p in range(STATES))
    return Summary(matrix, tuple(s["faults"]), s["illegal"], None if s["ends"] is None else tuple(s["ends"]))


ARROW_SUMMARY = pa.struct([
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("faults", pa.list_(pa.int64())), ("illegal", pa.int64()), ("ends", pa.string()),
])


def evaluated(symbols: Column, grammar: Grammar) -> Column:
    """The summary of a stretch: the product over its compressed sequence. A task evaluates equal sequences once."""
    rules = list(grammar.rules)

    @F.arrow_udf(SUMMARY)
    def summaries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Grammar(rules)
        by_symbol, known = own.summaries(), {}
        for batch in batches:
            found = []
            for text in batch.to_pylist():
                if text not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[text] = packed(reduce(Summary.then, map(by_symbol.__getitem__, own.compressed(text)), Summary()))
                found.append(known[text])
            yield pa.array(found, ARROW_SUMMARY)

    return summaries(symbols)


RESULT = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
ARROW_RESULT = pa.struct([(k.split(":")[0], pa.string() if "audit" in k else pa.int64()) for k in RESULT[7:-1].split(",")])


def balanced(parts: Sequence[Summary], join: Callable[[Summary, Summary], Summary]) -> Summary:
    """Joined in pairs, so that no rope gets deep."""
    parts = list(parts) or [Summary()]
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def outcome(pieces: list[dict]) -> dict:
    """A conversation from its stretches in order."""
    every = balanced([unpacked(p["summary"]) for p in pieces], Summary.then)
    ways = times(every.matrix, INSERTED)[START]
    cost, audit = reduce(better, [ways[q] for q in ENDS])
    numbered = [p for p in pieces if p["lo"] is not None]
    gaps = 0
    if numbered:
        seams = sum(a["hi"] == b["lo"] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1]["hi"] - numbered[0]["lo"] + 1 - (sum(p["turns"] for p in numbered) - seams)
    blank, duplicate, truncated = every.faults
    return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": every.illegal, "cost": cost, "audit": str(audit)}


def outcomes(pieces: Column) -> Column:
    @F.arrow_udf(RESULT)
    def found(batch: pa.Array) -> pa.Array:
        return pa.array([outcome(p) for p in batch.to_pylist()], ARROW_RESULT)

    return found(pieces)


def audits(rows: DataFrame, limit: int = STRETCH, rules: int = RULES, rounds: int = ROUNDS) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation in ``turn_rows``."""
    pieces = cut(stretches(told_apart(rows.drop("text")), limit))
    sequences = cut(pieces.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    grammar = learn_grammar(sequences, rules, rounds)
    each = pieces.withColumn("summary", evaluated(F.col("symbols"), grammar))
    parts = F.sort_array(F.collect_list(F.struct("part", "number", "lo", "hi", "turns", "summary")))
    # collect_list of what sorts by part and number alone: no two stretches of a conversation share both.
    found = each.groupBy("conv").agg(parts.alias("parts")).select("conv", outcomes(F.col("parts")).alias("found"))
    return found.select("conv", "found.*")


# ---- repaired turns ----------------------------------------------------------------------------------------------


class Editor:
    """Follows a conversation's audit through its turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def written(self) -> tuple[str, str]:
        """The role that must come next, as its letter and as a word."""
        letter = "a" if self.state == 2 else "u"
        self.state = NEXT[self.state][letter]
        return letter, {"u": "user", "a": "assistant"}[letter]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self.written()[1], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self.written()[1], text


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, tuple]]:
    """Events of a sorted stream of audits and turns: ``begin`` and ``end`` of a conversation, and its ``line``s."""
    conv, editor = None, None
    for batch in batches:
        for c, audit, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if audit is not None:
                if editor:
                    yield from (("line", conv, line) for line in editor.inserted())
                    yield "end", conv, ()
                conv, editor = c, Editor(audit)
                yield "begin", conv, ()
            else:
                for _ in range(copies):
                    yield from (("line", conv, line) for line in editor.turn(role, text))
    if editor:
        yield from (("line", conv, line) for line in editor.inserted())
        yield "end", conv, ()


def streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit and then its turns, in order. The stream is sorted on disk, not held in memory."""
    nothing = {"turn": "long", "late": "boolean", "role": "string", "digest": "binary", "text": "string", "copies": "long"}
    heads = found.select("conv", "audit", F.lit(0).alias("tag"), *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()])
    turns = in_order(rows.where("copies > 0")).select("conv", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("tag"), *nothing)
    ordered = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "tag", *ORDER[1:])
    return ordered.select("conv", "audit", "role", "text", "copies")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: of the repaired turns as lines ``role:text``. A hash of a text is made from its beginning to
    its end, so one task reads a conversation's turns; it keeps one of them at a time."""
    kind = found.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = [None]
        ready: list[tuple] = []

        def seen(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for item in items:
                own[0] = item.schema.field(0).type
                yield item

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*ready), (own[0], pa.string()))]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv", "repaired_sha256"])

        for event, conv, line in followed(seen(batches)):
            if event == "begin":
                sha, lines = hashlib.sha256(), 0
            elif event == "line":
                sha.update((("\n" if lines else "") + line[1] + ":" + line[2]).encode())
                lines += 1
            else:
                ready.append((conv, sha.hexdigest()))
                if len(ready) >= 5000:
                    yield out()
        if ready:
            yield out()

    return streamed(rows, found).mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv, place`` (from 0), ``edit`` (K, R or I), ``role, text``."""
    kind = found.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_type, lines in written_out(batches):
            columns = [pa.array(c, k) for c, k in zip(zip(*lines), (batch_type, pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "place", "edit", "role", "text"])

    return streamed(rows, found).mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string")


def written_out(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[tuple[pa.DataType, list[tuple]]]:
    """Repaired turns, so many at a time that their texts stay under some megabytes."""
    own: list = [None]

    def seen(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in items:
            own[0] = item.schema.field(0).type
            yield item

    ready, size, place = [], 0, 0
    for event, conv, line in followed(seen(batches)):
        if event == "begin":
            place = 0
        elif event == "line":
            ready.append((conv, place, *line))
            place, size = place + 1, size + len(line[2]) + 100
        if size > most:
            yield own[0], ready
            ready, size = [], 0
    if ready:
        yield own[0], ready


def repair(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None,
    limit: int = STRETCH, rules: int = RULES, rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """A row per conversation (``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``), and the rows of its turns,
    which ``digests`` and ``repaired_turns`` take with it.

    Turns go by number, NULL first; of one number by role, then by the SHA-256 of the text. ``copies`` says how many times a
    row stands (0: it only names its conversation). Equal rows are rows of their own, the later ones duplicates. NULL roles
    and texts are one space; a NULL conversation is one conversation. Other columns are not looked at.
    """
    rows = turn_rows(turns, conversation, turn, role, text, F.lit(1) if copies is None else copies)
    return cut(audits(rows, limit, rules, rounds)), rows
