"""Conversation repair against a search over all edits, turn by turn, without grammar or matrices."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from spectraloom.llm import conversations as c

INK = re.compile("[^\x20\x09-\x0d]")
FORM = re.compile("(s?(ua)+)?")


def cheapest(turns):
    """``turns``: (turn, role, text) in order. Every edit of every turn is tried; the best way to each last letter is kept."""
    seen, kinds = set(), []
    for _, role, text in turns:
        ink = INK.findall(text)
        kind = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    words = {"u": "user", "a": "assistant"}

    def follows(written, letter):
        last = written[-1:]
        return (letter == "s" and not written) or (letter == "u" and last in ("", "s", "a")) or (letter == "a" and last == "u")

    def keep_best(ways):
        best = {}
        for cost, audit, letters, lines in ways:
            key = letters[-1:]
            if key not in best or (cost, audit) < best[key][:2]:
                best[key] = (cost, audit, letters, lines)
        return list(best.values())

    def with_inserts(ways):
        for _ in range(3):
            ways = ways + [(n + 5, a + "I", w + x, [*o, words[x] + ":"]) for n, a, w, o in ways for x in "ua" if follows(w, x)]
        return keep_best(ways)

    ways = [(0, "", "", [])]
    for (_, role, text), kind in zip(turns, kinds):
        new = []
        for n, a, w, o in with_inserts(ways):
            new.append((n + 2, a + "D", w, o))
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                if role[:1] in ("s", "u", "a") and follows(w, role[0]):
                    new.append((n + extra, a + "K", w + role[0], [*o, f"{role}:{text}"]))
                new += [(n + 1 + extra, a + "R", w + x, [*o, f"{words[x]}:{text}"]) for x in "ua" if follows(w, x)]
        ways = keep_best(new)
    cost, audit, letters, lines = min((w for w in with_inserts(ways) if w[2][-1:] in ("", "a")), key=lambda w: w[:2])
    assert FORM.fullmatch(letters)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults = tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(turns, **options):
    found, rows = c.repair(turns, **options)
    hashes = c.digests(rows, found).withColumnRenamed("conv", "conv_")
    whole = found.join(hashes, F.col("conv").eqNullSafe(F.col("conv_"))).collect()
    assert len({r.conv for r in whole}) == len(whole)
    return {r.conv: tuple(r[k] for k in COLUMNS) for r in whole}, found, rows


def conversations_of(rows):
    """(conv, turn, role, text, copies) to the turns of each, as they stand."""
    every = {}
    for conv, turn, role, text, copies in rows:
        every.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    return {conv: in_order(turns) for conv, turns in every.items()}


def damaged(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        yield conv, turn, "user" if fault == 4 else role, text, {0: 0, 3: 2}.get(fault, 1)


def test_query_equals_search(spark, sf_dir):
    found = entry_module.queries()["op13_conversations"](spark, sf_dir)
    assert found.columns == ["conv_id", *COLUMNS]
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    wanted = {conv: cheapest(turns)[0] for conv, turns in conversations_of(damaged(map(tuple, source))).items()}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == wanted


FAULTY = st.tuples(
    st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["system", "user", "assistant", "tool", "", "u", None]),
    st.sampled_from(["Yes.", "No!", "cut off", "", " \t", "Yes. ", None, "…?", " "]), st.integers(0, 3),
)
SCHEMA = "conv_id long, turn long, role string, text string, stands int"


def random_rows(seed, conversations):
    from random import Random

    random = Random(seed)
    texts, roles = ["Yes.", "No!", "cut off", "", " \t", "Yes. ", None, "…?", " "], ["system", "user", "assistant", "tool", "", "u", None]
    for conv in range(conversations):
        for _ in range(random.randint(0, 9)):
            turn = random.choice([None, *range(7)])
            yield (None if conv == 3 else conv, turn, random.choice(roles[:3] * 3 + roles), random.choice(texts[:2] * 3 + texts), random.randint(0, 2))


@pytest.mark.parametrize(("limit", "rules", "rounds"), [(4096, 1024, 12), (2, 6, 3), (1, 1, 1), (3, 0, 1)])
def test_odd_conversations_in_short_stretches(spark, limit, rules, rounds):
    rows = list(random_rows(limit, 60))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found, _, _ = repaired(turns, copies=F.col("stands"), limit=limit, rules=rules, rounds=rounds)
    assert found == {conv: cheapest(t)[0] for conv, t in conversations_of(rows).items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(c.TERMINALS), max_size=9), st.data())
def test_products_equal_search(symbols, data):
    """Any way of cutting a sequence gives the costs and edits of the search."""
    texts = {c.FINE: "{}.", c.BLANK: "", c.DUPLICATE: "again.", c.CUT: "{}"}
    turns = []
    for i, symbol in enumerate(symbols):
        role, fault = divmod(c.TERMINALS.index(symbol), 4)
        turns.append((i, ["system", "user", "assistant", "other"][role], texts[fault].format(i)))
    own = []
    seen = set()
    for symbol, turn in zip(symbols, turns):
        role, fault = divmod(c.TERMINALS.index(symbol), 4)
        if fault == c.DUPLICATE and turn[1:] not in seen:
            fault = c.FINE
        seen.add(turn[1:])
        own.append(c.TERMINALS[role * 4 + fault])
    cuts = sorted(data.draw(st.lists(st.integers(0, len(own)), max_size=3)))
    parts = ["".join(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
    grammar = c.Grammar(["EI", c.Grammar.name(0) * 2, "AE"])
    by_symbol = grammar.summaries()
    summaries = [c.balanced([by_symbol[x] for x in grammar.compressed(p)], c.Summary.then) for p in parts]
    pieces = [{"summary": c.packed(s), "lo": None, "hi": None, "turns": 0} for s in summaries]
    found = c.outcome(pieces)
    wanted = cheapest(turns)[0]
    assert (found["blank"], found["duplicate"], found["truncated"], found["illegal"], found["cost"], found["audit"]) == wanted[1:7]


def test_grammar_takes_frequent_pairs(spark):
    sequences = spark.createDataFrame([("AEIEIEI", 5), ("EIEI", 7), ("KL", 1), ("", 3), ("A", 2)], "symbols string, n long")
    grammar = c.learn_grammar(sequences)
    assert grammar.rules[0] == "EI" and grammar.rules[1] == c.Grammar.name(0) * 2 and "KL" not in grammar.rules

    def expanded(text):
        for number in reversed(range(len(grammar.rules))):
            text = text.replace(grammar.name(number), grammar.rules[number])
        return text

    assert all(expanded(grammar.compressed(s)) == s for s in ("AEIEIEI", "EIEI", "KL", "", "A"))
    assert len(grammar.compressed("EIEIEIEI")) <= 2


def test_a_conversation_with_most_turns(spark):
    """One conversation holds nearly all rows, many of them copies; its stretches lie in several tasks once small partitions
    are not merged."""
    hot = spark.range(4000).selectExpr(
        "7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id % 5 = 0, 'same.', concat(id, '!')) as text", "1 as stands"
    )
    few = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 5000), (2, 0, "user", "x", 0)], SCHEMA)
    found, audits, rows = repaired(hot.unionByName(few).repartition(8), copies=F.col("stands"), limit=64)
    turns = [(i, "user" if i % 2 == 0 else "assistant", "same." if i % 5 == 0 else f"{i}!") for i in range(4000)]
    assert found[7] == cheapest(turns)[0]
    assert found[1][:7] == (0, 0, 4999, 0, 4999, 9998, "KK" + "D" * 4999)
    assert found[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        apart, _, _ = repaired(hot.repartition(8), copies=F.col("stands"), limit=64)
        pieces = c.stretches(c.told_apart(rows.drop("text")), 64).where("conv = 7").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert apart[7] == found[7]
    assert sum(len(p.symbols) for p in pieces) == 4000 and max(len(p.symbols) for p in pieces) <= 64
    assert len({p.part for p in pieces}) >= 2


def test_repaired_turns_are_those_hashed(spark):
    rows = list(random_rows(11, 30))
    found, audits, own = repaired(spark.createDataFrame(rows, SCHEMA), copies=F.col("stands"))
    lines = {}
    for r in sorted(c.repaired_turns(own, audits).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
        assert (r.edit == "I") <= (r.text == "")
    for conv, turns in conversations_of(rows).items():
        assert lines.get(conv, []) == cheapest(turns)[1]
    assert {conv: r[-1] for conv, r in found.items()} == {conv: hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() for conv in found}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty, copies=F.col("stands"))[0] == {}
    turns = spark.createDataFrame([("a", 1, "user", "Hi.", 1, "x", 2), (None, 2, None, None, 3, "y", 4)], "conv_id string, turn int, role string, text string, conv int, audit string, part int")
    found = repaired(turns)[0]
    assert found["a"][5:7] == (2, "D") and found[None][1:7] == (1, 0, 0, 0, 2, "D")
    long = "word " * 100_000 + "end."
    turns = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert repaired(turns)[0][1] == cheapest([(1, "user", long), (2, "assistant", "Yes.")])[0]
