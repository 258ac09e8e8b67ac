import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.llm import ctph
from spectraloom.llm.queries import op9_fingerprints


def plain_fingerprint(text):
    """Byte by byte: a rolling hash of seven bytes, chunks no shorter than half a block and no longer than four."""
    data, block = text.encode(), 1
    while len(data) > 64 * block:
        block *= 2
    hashes = []
    for i in range(len(data)):
        h = sum((data[i - k] + 1) * ctph.WEIGHTS[k] for k in range(min(7, i + 1))) % 2**32
        h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
        hashes.append(h ^ h >> 13)

    def written(size):
        own, last = [], 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and i + 1 - last >= max(1, size // 2):
                own.append(i + 1)
                last = i + 1
        chunks, last = [], 0
        for end in [*own, len(data)]:
            while end - last > 4 * size:
                chunks.append(data[last : last + 4 * size])
                last += 4 * size
            if end > last:
                chunks.append(data[last:end])
            last = end
        return "".join(ctph.ALPHABET[xxhash.xxh32(c).intdigest() % 64] for c in chunks)

    return f"{block}:{written(block)}:{written(2 * block)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (size_a, *signatures_a), (size_b, *signatures_b) = a.split(":"), b.split(":")
    best = 0.0
    for i in range(2):
        for j in range(2):
            if int(size_a) << i == int(size_b) << j:
                x, y = signatures_a[i], signatures_b[j]
                if x == y:
                    return 1.0
                distance = list(range(len(y) + 1))
                for n, c in enumerate(x, 1):
                    before, distance = distance, [n]
                    for k, d in enumerate(y):
                        distance.append(before[k] if c == d else 1 + min(before[k + 1], distance[k]))
                least = min(len(x), len(y))
                chance = 0.22 * least / (least + 16)
                best = max(best, (1 - distance[-1] / (len(x) + len(y)) - chance) / (1 - chance))
    return best


def brute(rows, fingerprint=ctph.fingerprint, likeness=ctph.likeness):
    """By the order of identifiers, one after another."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        changed, mark = text[: len(text) - third] + following[:third], fingerprint(text)
        new = fingerprint(changed)
        yield doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, new, likeness(mark, new), likeness(mark, fingerprint(following))


def test_a_second_way_to_sign_and_compare(documents):
    """Beginnings of forty documents and some odd texts: plain loops over bytes and tables."""
    rows = [(r.doc_id, (r.text or "")[:3000]) for r in documents.orderBy("doc_id").limit(40).collect()]
    rows += [(-1, "abc"), (-2, "abd"), (-3, ""), (-4, "same line\n" * 200), (-5, "É𝔘 " * 150), (-6, "a" * 700)]
    for found, wanted in zip(brute(rows), brute(rows, plain_fingerprint, plain_likeness), strict=True):
        assert found[:5] == wanted[:5] and found[5:] == pytest.approx(wanted[5:], abs=1e-12)


def test_scattered_edits_are_seen():
    """One character in every three differs: no long run in common, and yet alike."""
    a = ctph.ALPHABET
    b = "".join("+" if i % 3 == 0 else c for i, c in enumerate(a))
    assert ctph.signatures_alike(a, b) > 0.5
    assert 0 < ctph.likeness(ctph.fingerprint("abc"), ctph.fingerprint("abd")) < 1


def test_query_equals_brute_force(spark, sf_dir, documents):
    wanted = list(brute([(r.doc_id, r.text or "") for r in documents.collect()]))
    found = op9_fingerprints(spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    edits, others = sorted(w[5] for w in wanted), sorted(w[6] for w in wanted)
    assert edits[len(edits) // 20] > 0.4 and others[len(others) * 9 // 10] < 0.2


@pytest.mark.parametrize("count", [1, 2, 3, 50])
def test_any_number_of_documents(spark, count):
    choice = random.Random(count)
    rows = [(choice.randrange(-20, 20), "".join(choice.choice("ab é") for _ in range(choice.randrange(40)))) for _ in range(count)]
    found = ctph.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))


def common(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, table[j + 1] = table[j + 1], before + 1 if x == y else max(table[j], table[j + 1])
    return table[-1]


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_common_subsequence(a, b):
    assert ctph.common_length(a, b) == common(a, b)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200), st.text(max_size=200))
def test_likeness_bounds(a, b):
    x, y = ctph.fingerprint(a), ctph.fingerprint(b)
    assert ctph.likeness(x, x) == 1 and 0 <= ctph.likeness(x, y) == ctph.likeness(y, x) <= 1


def test_blocks_of_bytes_do_not_matter(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefgh \n") for _ in range(5000)) + "line again\n" * 300
    whole = ctph.fingerprint(text)
    monkeypatch.setattr(ctph, "BLOCK", 97)
    assert ctph.fingerprint(text) == whole
    assert all(len(s) <= ctph.LONGEST for s in whole.split(":")[1:])


def test_columns(spark):
    df = spark.createDataFrame([("some text, long enough",), (None,), ("",)], "text string")
    marks = df.select(ctph.fingerprints(F.col("text")).alias("f"))
    assert [r.f for r in marks.collect()] == [ctph.fingerprint("some text, long enough"), "1::", "1::"]
    assert [r[0] for r in marks.select(ctph.alike(F.col("f"), F.lit("1::"))).collect()] == [0, 1, 1]


def test_odd_tables(spark, odd_documents):
    found = ctph.compare_edits(odd_documents).collect()
    assert len(found) == odd_documents.count()
    lost = [r for r in found if r.doc_id is None]
    assert len(lost) == 2 and all(r.near_next == 1 for r in lost)
    known = [(r.doc_id, r.text or "") for r in odd_documents.collect() if r.doc_id is not None]
    assert sorted(tuple(r) for r in found if r.doc_id is not None) == sorted(brute(known))
    assert ctph.compare_edits(odd_documents.limit(0)).collect() == []


def test_signatures_cover_texts_of_repeated_lines():
    """Where triggers recur with the lines, the signature still ends with the text."""
    choice, long = random.Random(7), 0
    for _ in range(300):
        line = "".join(choice.choice("abcdefgh ") for _ in range(choice.randint(3, 30))) + "\n"
        text = line * (20_000 // len(line))
        data, size = text.encode(), len(text)
        block = 1
        while size > block * ctph.TARGET:
            block *= 2
        if len(ctph.triggers(data, block)) < ctph.LONGEST:
            continue
        long += 1
        tail = "".join(choice.choice("ijklmnop ") for _ in range(size // 3))
        changed = text[: size - len(tail)] + tail
        assert all(len(s) <= ctph.LONGEST for s in ctph.fingerprint(text).split(":")[1:])
        assert ctph.fingerprint(text) == ctph.fingerprint(line * (20_000 // len(line)))
        assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(changed)) < 0.95
    assert long > 5
