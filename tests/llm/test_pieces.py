import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.llm import pieces as module
from spectraloom.llm.queries import op3_pieces

TEXTS = ["", "a", "the cat", " x  y", "é你\nb", "hello, wo", "𝔘a b", "$$$ a'b", "a a a", "ab ab"]


@pytest.fixture(scope="module")
def pieces(piece_model):
    return module.Pieces.of(piece_model, 4)


def every(pieces, text):
    """All segmentations of a text, by trying every piece everywhere: scores and ids, best first."""
    found = [[] for _ in range(len(text) + 1)]
    found[0] = [(0.0, ())]
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in pieces.ids:
                score, ids = pieces.scores[piece], (pieces.ids[piece],)
            elif len(piece) == 1:
                score, ids = pieces.unknown, tuple(pieces.bytes[b] for b in piece.encode())
            else:
                continue
            found[end] += [(s + score, before + ids) for s, before in found[start]]
    return sorted(found[-1], reverse=True)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_all_segmentations(pieces, text):
    (found,) = pieces.encode([text])
    wanted = every(pieces, pieces.normalized(text))
    assert [s for s, _ in found] == [s for s, _ in wanted[:4]]
    assert len({tuple(ids) for _, ids in found}) == len(found) and all((s, tuple(map(int, ids))) in wanted for s, ids in found)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="the a.\né", max_size=9))
def test_generated_texts(pieces, text):
    (found,) = pieces.encode([text])
    assert [s for s, _ in found] == [s for s, _ in every(pieces, pieces.normalized(text))[:4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=40), max_size=5))
def test_round_trip(pieces, texts):
    for text, found in zip(texts, pieces.encode(texts)):
        assert all(pieces.decode(ids.tolist()) == text for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_query(spark, sf_dir, documents):
    found = op3_pieces(spark, sf_dir).collect()
    assert len(found) == documents.count() and all(r.round_trip for r in found)
    assert all(r.next_score is None or r.next_score <= r.best_score for r in found)


def test_odd_tables_and_decoding(spark, odd_documents, piece_model):
    encoded = module.encode(odd_documents, piece_model, n=2)
    rows = encoded.collect()
    assert len(rows) == odd_documents.count() and all(r.round_trip for r in rows)
    texts = sorted(r.text or "" for r in odd_documents.collect())
    best = encoded.select(module.decode(F.col("ids")[0]["ids"], piece_model).alias("text"))
    assert sorted(r.text for r in best.collect()) == texts
    assert module.encode(odd_documents.limit(0), piece_model).collect() == []
    assert best.select(module.decode(F.lit(None).cast("array<int>"), piece_model)).first()[0] is None
