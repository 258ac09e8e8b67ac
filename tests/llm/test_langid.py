import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm import langid
from spectraloom.llm.queries import op2_language

MODEL = langid.LanguageModel.of({"en": Counter({"the": 5, "house": 2, "it": 1}), "de": Counter({"das": 5, "haus": 2, "für": 1})})


def test_held_out_accuracy(spark, sf_dir, documents):
    found = {r.doc_id: r for r in op2_language(spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} == {d for d, r in found.items() if r.held_out}
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_words_first_then_shorter_grams():
    assert (MODEL.score("the")[0] == MODEL.words["the"]).all()
    unseen = MODEL.score("houses")[0]
    # ^hou ses$ has no longest gram of its own: hous is in "house", s$ in "haus" and "das"
    assert (unseen == MODEL.backed_off("houses")).all() and unseen[1] > unseen[0]
    parts = MODEL.grams[3]["^hou"] + MODEL.grams[1]["se"] + MODEL.grams[1]["s$"]
    assert unseen == pytest.approx(parts)
    assert (MODEL.backed_off("日") == MODEL.grams[0]["^"] + MODEL.grams[0]["$"]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="theHausfürÜ 1.²½…“\n日", max_size=40)), min_size=1, max_size=6))
def test_units_do_not_change_sums(texts):
    sums = langid.Scorer(MODEL).sums(pa.array(texts, pa.string()))
    for row, text in zip(sums, texts):
        wanted, words = MODEL.score(text or "")
        assert row[:-1] == pytest.approx(wanted) and row[-1] == words
        assert (langid.verdicts(MODEL, row[None])[0] == ["und"]) == (not any(map(str.isalpha, text or "")))


def test_odd_tables(spark, odd_documents):
    model = langid.learn_languages(langid.taught(odd_documents))
    found = langid.identify(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and {r.lang_pred for r in found} <= {*model.languages, "und"}
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4, 6)} == {"und"}
    nothing = langid.learn_languages(odd_documents.limit(0))
    assert nothing.languages == [] and {r.lang_pred for r in langid.identify(odd_documents, nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} tail", "xx") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_languages(df, sample=100, words=3)
    assert model.languages == ["xx"] and len(model.words) == 3 and "tail" in model.words


def test_every_language_is_learned(spark):
    """However many there are, each has a word of its own; what has no room is counted."""
    rows = [(i, f"{letters_of(i % 130)} common", f"lang{i % 130}") for i in range(390)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_languages(df)
    assert len(model.languages) == 130 and model.left_out == 0
    assert all(r.lang_pred == f"lang{r.doc_id % 130}" for r in langid.identify(df, model).collect())
    assert langid.words_each(4) == langid.WORDS and langid.words_each(200) == 400 and langid.words_each(10_000) == langid.LEAST_WORDS
    assert langid.learn_languages(df, words=1).left_out == 130


def letters_of(number):
    """Words without letters in common places."""
    return "".join(chr(ord("a") + number // 26**k % 26) * 2 for k in range(3))


def test_scores_do_not_depend_on_the_batch(spark, documents):
    texts = [r.text for r in documents.limit(60).collect()]
    model = langid.learn_languages(langid.taught(documents))
    every = langid.Scorer(model).sums(pa.array(texts, pa.string()))
    alone = [langid.Scorer(model).sums(pa.array([t], pa.string()))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(every, alone))
    sums = [model.score(t) for t in texts]
    names, scores = langid.verdicts(model, every)
    for (wanted, words), name, score in zip(sums, names, scores):
        best = int(wanted.argmax())
        assert (name, score) == ("und", 0) if not words else name == model.languages[best]
        if words:
            assert score == pytest.approx(1 / sum(2.718281828459045 ** ((w - wanted[best]) / words**0.5) for w in wanted))
