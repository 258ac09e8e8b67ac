import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spectraloom.llm import packing
from spectraloom.llm.queries import op10_packing


@pytest.fixture(scope="module")
def reference(word_model):
    tokenizer = Tokenizer.from_file(word_model)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def verify(pieces, ids, window=2048):
    """Every id in exactly one piece, sequences gapless and no longer than the window; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = np.array(ids[doc][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.length == len(part) > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[doc])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_equals_the_tokenizer(spark, sf_dir, documents, reference):
    ids = {r.doc_id: reference(r.text) for r in documents.collect()}
    padding = verify(op10_packing(spark, sf_dir).collect(), ids)
    assert padding <= 0.005 * sum(map(len, ids.values()))


ODD = ["a'sb!'s 12'34 don't  stop... …. x\x1c\x1dy  \x00 áB É'S", "", "  ", "<|endoftext|> x", "É x<|startoftext|><|endoftext|>y <|endoftext|", "a <|ENDOFTEXT|> é<|endoftext|>'s", "İstanbul ſs K 　z  q", "é ́x 'll'", "1" * 500, "x" * 5000, "...“a”…b ß'"]


def test_units_do_not_change_the_ids(word_model, reference):
    words = packing.WordTokenizer(word_model)
    for _ in range(2):  # new, then remembered
        assert [list(ids) + [1] for ids in words.encode(pa.array(ODD))] == [reference(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb 'sdé́1.!… \n\x1cİß", max_size=30), min_size=1, max_size=8))
def test_generated_texts(word_model, reference, texts):
    words = packing.WordTokenizer.of(word_model)
    assert [list(ids) + [1] for ids in words.encode(pa.array(texts))] == [reference(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        open_ = [w for w in rooms if w[0] >= lengths[i]]
        if open_:
            least = min(w[0] for w in open_)
            # equal rooms are interchangeable
            chosen = next(w for w in open_ if w[0] == least)
            chosen[0] -= lengths[i]
        else:
            rooms.append([64 - lengths[i]])
    found = sorted(64 - sum(lengths[i] for i in w) for w in packing.best_fit(lengths, 64))
    assert found == sorted(r for r, in rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_layouts_hold_every_token_once(lengths):
    sequences = packing.lay_out(lengths, 64, slack=4)
    seen = sorted((i, start + k) for pieces in sequences for i, start, length in pieces for k in range(length))
    assert seen == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    assert all(0 < (filled := sum(p[2] for p in pieces)) <= 64 and (filled & (filled - 1) == 0 or filled >= 60) for pieces in sequences)


def test_groups_are_bounded(spark, word_model, reference):
    choice = random.Random(2)
    texts = ["".join(choice.choice("ab cd ") for _ in range(choice.randint(0, 4000))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = packing.pack(docs, word_model, window=256, group_tokens=3000, with_ids=True).collect()
    verify(found, {i: reference(t) for i, t in enumerate(texts)}, 256)
    assert all(p.ids == reference(texts[p.doc_id])[p.start : p.start + p.length] for p in found)


def test_odd_tables(spark, odd_documents, word_model):
    found = packing.pack(odd_documents, word_model).collect()
    assert sum(p.length for p in found if p.doc_id == 2) == 1 and sum(p.start == 0 for p in found if p.doc_id is None) == 2
    assert sum(p.start == 0 for p in found) == odd_documents.count()
    assert packing.pack(odd_documents.limit(0), word_model).collect() == []
