import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import toxicity
from spectraloom.llm.queries import op8_toxicity


def examples(count, seed=0):
    """Clean words, and in toxic texts two insults: one as it is, one in new forms."""
    choice = random.Random(seed)
    words = ["".join(choice.choice("aeiou") + choice.choice("ndrst") for _ in range(3)) for _ in range(300)]
    texts, labels = [], []
    for i in range(count):
        text = [choice.choice(words) for _ in range(choice.randint(1, 80))]
        if i % 4 == 0:
            text.insert(choice.randrange(len(text) + 1), choice.choice(["IDIOT!!", "clown", "zorgu" + choice.choice(words)]))
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    texts, labels = examples(1500)
    return toxicity.train([toxicity.encoded(t) for t in texts], labels)


def test_held_out_accuracy(net):
    texts, labels = examples(600, seed=1)
    texts = [t.replace("idiot", "Idiot") for t in texts]
    scores = np.array(list(toxicity.Scorer(net).scores(pa.array(texts))))
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.9
    words = np.array(list(toxicity.Scorer(net).scores(pa.array(["", None, " . ", "nothing here", "clown", "Zorguxyz " * 3]))))
    assert (words[:4] < 0.5).all() and (words[4:] > 0.5).all() and words[0] == words[1] == words[2]


def test_scores_follow_the_net(net):
    """Units, blocks and stretches of long texts do not change the convolution."""
    texts = examples(20, seed=2)[0] + ["word " * 3000 + "clown"]
    for text, score in zip(texts, toxicity.Scorer(net).scores(pa.array(texts))):
        words = toxicity.letters(text.lower())
        vectors = np.concatenate([np.array([net.vector(w) for w in words]), np.zeros((3, toxicity.DIMENSIONS))])
        hidden = []
        for width, kernel in zip(toxicity.WIDTHS, net.filters):
            windows = [sum(vectors[t + j] @ kernel[j] for j in range(width)) for t in range(len(words) + 1)]
            hidden.append(np.max(windows, axis=0))
        z = np.maximum(np.concatenate(hidden) + net.biases, 0) @ net.weights + net.bias - net.thresholds[toxicity.guess(words)]
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_long_texts_are_pooled_in_stretches(net, monkeypatch):
    text = pa.array([" ".join(examples(60, seed=5)[0])])
    whole = list(toxicity.Scorer(net).scores(text))
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    assert list(toxicity.Scorer(net).scores(text)) == pytest.approx(whole)


def test_thresholds():
    assert toxicity.best_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3
    assert toxicity.best_threshold(np.array([3.0]), np.array([0])) > 3


def test_query(spark, sf_dir, documents):
    found = op8_toxicity(spark, sf_dir).collect()
    assert len(found) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_odd_tables(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 2), (2, None, 1), (None, 1, 1), (5, 0, 0), (5, 0, 0), (99, 1, 1)], "doc_id long, toxic int, text int")
    net = toxicity.learn_toxicity(odd_documents, labels)
    found = toxicity.score_toxicity(odd_documents, net).collect()
    assert len(found) == odd_documents.count() and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.learn_toxicity(odd_documents, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(odd_documents, nothing).collect()} == {0}
    assert toxicity.score_toxicity(odd_documents.limit(0), nothing).collect() == []


def test_thresholds_count_all_rows_left_out(spark, monkeypatch):
    """At any size of the sample, every learnable row is learned from or counted, at the ratio of all of them."""
    texts, labels = examples(600, seed=3)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string")
    known = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "doc_id long, toxic int")
    own = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5]
    given, calibrate = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda net, counts, learned: (given.append((counts, learned)), calibrate(net, counts, learned)))
    for sample in (40, 10_000):
        net = toxicity.learn_toxicity(docs, known, sample)
        counts, learned = given.pop()
        kept = np.bincount(counts[:, 0], counts[:, 3], 2)
        assert (kept + learned).tolist() == [sum(labels[i] == k for i in own) for k in (0, 1)]
        assert kept.min() > 0 and len(own) // 10 < kept.sum() and learned.max() < 2 * sample
        scores = np.array(list(toxicity.Scorer(net).scores(pa.array([texts[i] for i in own]))))
        assert ((scores >= 0.5) == np.array([labels[i] for i in own])).mean() > 0.7


def test_weighted_thresholds():
    """Where labels overlap, the ratio of the labels decides; a bin's edge is a threshold, its inside is not."""
    logits, labels = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])
    assert toxicity.best_threshold(logits, labels, np.array([10, 5, 1, 3]), 0.5) == 1.75
    assert toxicity.best_threshold(logits, labels, np.array([10, 1, 5, 3]), 0.5) == 0.75


def test_words_reach_the_driver_once(spark, monkeypatch):
    """The sample goes to the driver as numbers of words, each of which has its parts there once; the net is that of whole texts."""
    texts, labels = examples(600, seed=4)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(600, ""), (601, "seldom")], "doc_id long, text string")
    own = spark.createDataFrame(list(enumerate(labels + [0, 0])), "doc_id long, toxic int")
    sizes, plans, collect = [], [], type(docs).toArrow

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        sizes.append((found := collect(df)).nbytes)
        return found

    monkeypatch.setattr(type(docs), "toArrow", kept)
    known, words, orders, toxic = toxicity.labelled_sample(docs, own)
    monkeypatch.undo()
    assert all(p.count("ArrowEvalPython [") <= 1 for p in plans), "each stage of Python needs workers of its own"
    tokens, distinct = sum(len(t.split()) for t in texts), len({w for t in texts for w in t.split()})
    assert sum(sizes) < 4 * tokens + 40 * 602 + 100 * distinct
    assert toxic == labels + [0, 0] and orders[600].tolist() == [] and orders[601].tolist() == [0]
    net = toxicity.fit(known, words, orders, toxic)
    whole = [toxicity.encoded(t) for t in [*texts, "", "seldom"]]
    documents = np.bincount(np.concatenate([np.unique(t.parts) for t in whole]), minlength=toxicity.BUCKETS)
    assert known.tolist() == np.flatnonzero(documents >= toxicity.LEAST_DOCUMENTS).tolist()
    for text, order in zip(texts[:50], orders):
        assert toxicity.Text(order, words).vectors(net) == pytest.approx(np.array([net.vector(w) for w in toxicity.letters(text.lower())]))
