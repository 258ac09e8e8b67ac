"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its beginnings and endings, so new forms of a
word are known by their parts. Filters over one, two and three words in a row are pooled by their maximum over the whole
text, and a logistic layer weighs the maxima. Thresholds are calibrated by language on labelled rows kept out of the
training; a language is guessed from the text's own function words, and the score is shifted so that 0.5 is its threshold.

The weights are learned from a bounded sample of labelled documents (about ``SAMPLE`` rows of either label). All other
labelled rows, one in ``CALIBRATION`` at least, are scored and counted in bins by Spark for the thresholds, weighted to the
ratio of the labels among all labelled rows. Scoring covers every document's whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.names import number_array
from spectraloom.llm.common import fresh, remainder, stored
from spectraloom.llm.langid import letters, word_classes
from spectraloom.llm.units import UnitTable, blocks, by_classes, grown, kept

#: About so many labelled documents of each label are learned from.
SAMPLE = 3000
BUCKETS = 1 << 20
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Rounds over the sample: about ``STEPS`` documents in all, within these bounds.
EPOCHS, MOST_EPOCHS, STEPS = 6, 30, 20_000
RATE = 0.1
#: Parts of words in fewer documents of the sample are not embedded.
LEAST_DOCUMENTS = 3
BEGINNINGS = (3, 4, 5, 6, 7, 8)
ENDINGS = (4,)
#: One in so many labelled documents is never learned from: with those not drawn, it calibrates the thresholds.
CALIBRATION = 5
#: Logits are counted in so many bins for each unit, those beyond ``FARTHEST`` in the outermost ones.
BINS, FARTHEST = 64, 64
#: A language with fewer toxic documents there shares the common threshold.
LEAST_TOXIC = 20
REMEMBERED = 250_000
#: Words convolved together, to bound memory on long texts.
STRETCH = 200_000

# Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "den"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for"),
    "es": ("el", "los", "las", "que", "y", "del", "por", "una", "con", "para"),
    "fr": ("le", "les", "des", "et", "est", "une", "dans", "pour", "qui", "pas"),
}
GUESS = {word: i + 1 for i, name in enumerate(FUNCTION_WORDS) for word in FUNCTION_WORDS[name]}
GUESSES = len(FUNCTION_WORDS) + 1


def features(word: str) -> list[int]:
    """Hashes of a word, its beginnings and its endings."""
    parts = [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k), *("-" + word[-k:] for k in ENDINGS if len(word) > k)]
    return [xxhash.xxh32_intdigest(p) % BUCKETS for p in parts]


@dataclass
class ConvNet:
    """``rows`` leads from a hash to its embedding; row 0, all zero, stands for unknown parts."""

    rows: dict[int, int]
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray

    @classmethod
    def new(cls, known: list[int], seed: int = 0) -> ConvNet:
        random = np.random.default_rng(seed)
        embeddings = random.normal(0, 0.1, (len(known) + 1, DIMENSIONS))
        embeddings[0] = 0
        filters = [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls({h: i + 1 for i, h in enumerate(known)}, embeddings, filters, np.zeros(n), random.normal(0, 0.3, n), 0.0, np.zeros(GUESSES))

    def parts(self, word: str) -> list[int]:
        """Rows of the known parts of a word."""
        return [r for h in features(word) if (r := self.rows.get(h))] if word else []

    def vector(self, word: str) -> np.ndarray:
        return self.embeddings[self.parts(word)].sum(axis=0)

    def pooled(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over a text (without biases), and the places of them by width.

        Texts are padded with zero vectors, so every width has a window.
        """
        most, places = [], []
        for width, kernel in zip(WIDTHS, self.filters):
            padded = np.concatenate([vectors, np.zeros((width, DIMENSIONS), vectors.dtype)])
            best, where = np.full(FILTERS, -np.inf), np.zeros(FILTERS, np.int64)
            windows = len(padded) - width + 1
            for begin in range(0, windows, STRETCH):
                count = min(STRETCH, windows - begin)
                found = sum(padded[begin + j : begin + j + count] @ kernel[j] for j in range(width))
                at = found.argmax(axis=0)
                high = found[at, np.arange(FILTERS)]
                where, best = np.where(high > best, at + begin, where), np.maximum(best, high)
            most.append(best)
            places.append(where)
        return np.concatenate(most), places

    def logit(self, vectors: np.ndarray) -> float:
        return float(np.maximum(self.pooled(vectors)[0] + self.biases, 0) @ self.weights + self.bias)


def guess(words: list[str]) -> int:
    """Number of the language with the most function words in the text; 0 without any."""
    counts = np.bincount([GUESS[w] for w in words if w in GUESS], minlength=GUESSES)
    return int(counts.argmax()) if counts.any() else 0


class Encoded(NamedTuple):
    """A text's distinct words as hashes of their parts, one word after another, the number of parts of each, the text as
    numbers of these words, and its language as guessed."""

    parts: np.ndarray
    counts: np.ndarray
    order: np.ndarray
    language: int


def encoded(text: str) -> Encoded:
    words = letters(text.lower())
    places = {w: i for i, w in enumerate(dict.fromkeys(words))}
    parts = [features(w) for w in places]
    return Encoded(
        np.array([h for p in parts for h in p], np.int32), np.array(list(map(len, parts)), np.int32), np.array([places[w] for w in words], np.int32), guess(words)
    )


class Words:
    """Words that all texts share, each by its parts, one word after another; ``counts`` has the number of parts of each."""

    def __init__(self, parts: np.ndarray, counts: np.ndarray):
        self.parts, self.ends = parts, np.cumsum(counts, dtype=np.int64)
        self.begins = self.ends - counts

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the words with these numbers, one after another, and how many each has."""
        begins, counts = self.begins[numbers], self.ends[numbers] - self.begins[numbers]
        after = np.cumsum(counts)
        return self.parts[np.repeat(begins - (after - counts), counts) + np.arange(counts.sum())], counts


class Text:
    """A text as numbers of words, whose parts are rows of embeddings. Unknown parts have row 0."""

    def __init__(self, order: np.ndarray, words: Words):
        self.order, self.words = order, words

    def vectors(self, net: ConvNet) -> np.ndarray:
        if not len(self.order):
            return np.zeros((0, DIMENSIONS))
        distinct, order = np.unique(self.order, return_inverse=True)
        rows, counts = self.words.of(distinct)
        return np.add.reduceat(net.embeddings[rows], np.cumsum(counts) - counts, axis=0)[order]

    def parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words at these places, and for each row which of the places it is from. Places beyond the end have none."""
        inside = np.flatnonzero(at < len(self.order))
        rows, counts = self.words.of(self.order[at[inside]])
        return rows, np.repeat(inside, counts)


class Trainer:
    """Stochastic gradients with a step size of its own for each weight (Adagrad)."""

    def __init__(self, net: ConvNet):
        self.net = net
        self.seen = {"embeddings": np.full(net.embeddings.shape, 1e-8), "biases": np.full(net.biases.shape, 1e-8), "weights": np.full(net.weights.shape, 1e-8), "bias": 1e-8}
        self.seen_filters = [np.full(f.shape, 1e-8) for f in net.filters]

    def step(self, text: Text, label: int, weight: float) -> None:
        net = self.net
        vectors = text.vectors(net)
        most, places = net.pooled(vectors)
        hidden = np.maximum(most + net.biases, 0)
        z = hidden @ net.weights + net.bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        back = error * net.weights * (hidden > 0)
        padded = np.concatenate([vectors, np.zeros((max(WIDTHS), DIMENSIONS))])
        places_hit, changes = [], []
        for i, (width, where) in enumerate(zip(WIDTHS, places)):
            own, kernel = back[i * FILTERS : (i + 1) * FILTERS], net.filters[i]
            at = where[None, :] + np.arange(width)[:, None]
            places_hit.append(at.ravel())
            changes.append((kernel * own).transpose(0, 2, 1).reshape(-1, DIMENSIONS))
            change = padded[at].transpose(0, 2, 1) * own
            self.seen_filters[i] += change**2
            net.filters[i] = kernel - RATE * change / np.sqrt(self.seen_filters[i])
        hit, source = text.parts(np.concatenate(places_hit))
        rows, inverse = np.unique(hit, return_inverse=True)
        change = np.zeros((len(rows), DIMENSIONS))
        np.add.at(change, inverse, np.concatenate(changes)[source])
        change[rows == 0] = 0
        self.seen["embeddings"][rows] += change**2
        net.embeddings[rows] -= RATE * change / np.sqrt(self.seen["embeddings"][rows])
        for name, change in (("biases", back), ("weights", error * hidden)):
            self.seen[name] += change**2
            setattr(net, name, getattr(net, name) - RATE * change / np.sqrt(self.seen[name]))
        self.seen["bias"] += error**2
        net.bias -= RATE * error / np.sqrt(self.seen["bias"])


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, width: float = 0.0) -> float:
    """The logit that separates the labels with the fewest errors; of equal ones the middle of the widest gap.

    With ``width``, a logit stands for those from itself to as much above.
    """
    weights = np.ones(len(labels)) if weights is None else weights
    z, at = np.unique(logits, return_inverse=True)
    toxic, clean = np.bincount(at, weights * labels, len(z)), np.bincount(at, weights * (1 - labels), len(z))
    errors = np.concatenate([[0], np.cumsum(toxic)]) + clean.sum() - np.concatenate([[0], np.cumsum(clean)])
    lower, upper = np.concatenate([[z[0] - 1], z + width]), np.concatenate([z, [z[-1] + width + 1]])
    gaps = np.where(np.isclose(errors, errors.min(), rtol=1e-9, atol=1e-9), upper - lower, -1.0)
    k = int(gaps.argmax())
    return float((lower[k] + upper[k]) / 2)


def bins(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -FARTHEST, FARTHEST) * BINS).astype(np.int64)


def calibrate(net: ConvNet, counts: np.ndarray, learned: np.ndarray) -> None:
    """Set the thresholds by rows ``toxic, language, bin, n`` of ``counts`` and how many of either label were learned from.

    Rows of a label are weighted so that they stand for those learned from as well. A text without words counts as clean.
    """
    counts = np.concatenate([counts, [[0, 0, bins(np.array([net.logit(np.zeros((0, DIMENSIONS)))]))[0], 1]]])
    toxic, language, logits, n = counts[:, 0], counts[:, 1], counts[:, 2] / BINS, counts[:, 3]
    kept = np.bincount(toxic, n, 2)
    weights = n * ((kept + learned) / np.maximum(kept, 1))[toxic]
    common = best_threshold(logits, toxic, weights, 1 / BINS)
    for name in range(GUESSES):
        own = language == name
        enough = min(np.bincount(toxic[own], n[own], 2)) >= LEAST_TOXIC
        net.thresholds[name] = best_threshold(logits[own], toxic[own], weights[own], 1 / BINS) if enough else common


def rows_of(known: np.ndarray) -> np.ndarray:
    """For each hash its row of embeddings, 0 for those not known."""
    rows = np.zeros(BUCKETS, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    return rows


def fit(known: np.ndarray, words: Words, texts: list[np.ndarray], labels: list[int], seed: int = 0, learned: list[int] | None = None) -> ConvNet:
    """A net of labelled texts, or of those of them that ``learned`` numbers; all thresholds are 0.

    ``known`` has the hashes that are embedded, ``words`` the rows of these; the texts are numbers of words. Without both
    labels: a net that says 0.
    """
    net = ConvNet.new(known.tolist(), seed)
    if len(set(labels)) < 2:
        net.weights[:], net.bias = 0, 5.0 if labels and labels[0] else -5.0
        return net
    # A text without words is clean: it is among the examples.
    inputs, labels, last = [Text(t, words) for t in [*texts, np.zeros(0, np.int32)]], [*labels, 0], len(texts)
    learned = list(range(last)) if learned is None else learned
    learned, toxic = learned + [last] * max(1, len(learned) // 100), sum(labels[i] for i in learned)
    weight = {1: len(learned) / (2 * toxic), 0: len(learned) / (2 * (len(learned) - toxic))}
    trainer, random = Trainer(net), np.random.default_rng(seed)
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, STEPS // len(learned)))):
        for i in random.permutation(learned):
            trainer.step(inputs[i], labels[i], weight[labels[i]])
    return net


def train(texts: list[Encoded], labels: list[int], seed: int = 0) -> ConvNet:
    """A net of labelled texts in memory; every ``CALIBRATION``-th one is kept for the thresholds."""
    kept = [i for i in range(len(texts)) if i % CALIBRATION == CALIBRATION - 1]
    learned = [i for i in range(len(texts)) if i % CALIBRATION != CALIBRATION - 1]
    if len({labels[i] for i in kept}) < 2 or len({labels[i] for i in learned}) < 2:
        kept = learned = list(range(len(texts)))
    documents = np.zeros(BUCKETS, np.int64)
    for text in texts:
        documents[np.unique(text.parts)] += 1
    known, nothing = np.flatnonzero(documents >= LEAST_DOCUMENTS), [np.zeros(0, np.int32)]
    words = Words(rows_of(known)[np.concatenate([t.parts for t in texts] + nothing)], np.concatenate([t.counts for t in texts] + nothing))
    before = np.cumsum([0, *(len(t.counts) for t in texts)])
    orders = [t.order + n for t, n in zip(texts, before)]
    net = fit(known, words, orders, labels, seed, learned)
    if len(set(labels)) < 2:
        return net
    logits = np.array([net.logit(Text(orders[i], words).vectors(net)) for i in kept])
    counts = np.stack([[labels[i] for i in kept], [texts[i].language for i in kept], bins(logits), np.ones(len(kept), int)], axis=1)
    calibrate(net, counts, np.bincount([labels[i] for i in learned], minlength=2) * (kept is not learned))
    return net


class Scorer:
    """Scores of texts, with the vectors of units remembered."""

    def __init__(self, net: ConvNet):
        self.net = net
        self.units = UnitTable(by_classes(word_classes()), self.learn)
        self.forget()

    @classmethod
    def of(cls, net: ConvNet) -> Scorer:
        return kept((cls, id(net)), lambda: cls(net))

    def forget(self) -> None:
        self.units.forget()
        self.vectors, self.guesses, self.known = np.zeros((1 << 12, DIMENSIONS)), np.zeros(1 << 12, np.int64), 0

    def learn(self, units: list[bytes]) -> np.ndarray:
        total = self.known + len(units)
        self.vectors, self.guesses = grown(self.vectors, total), grown(self.guesses, total)
        for k, unit in enumerate(units, self.known):
            word = "".join(letters(unit.decode().lower()))
            self.vectors[k], self.guesses[k] = self.net.vector(word), GUESS.get(word, 0)
        numbers = np.arange(self.known, total)
        self.known = total
        return numbers

    def logits(self, texts: pa.Array) -> Iterator[tuple[float, int]]:
        """Logits and languages as guessed."""
        for data, begins in blocks(texts):
            if self.known > REMEMBERED:
                self.forget()
            data = data.lower()  # bytes.lower: ASCII only, learn() does the rest
            starts, ends = self.units.split(data)
            numbers = self.units.numbers(data, starts, ends)
            bounds = np.searchsorted(starts, np.append(begins, len(data) + 1)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = numbers[a:b]
                counts = np.bincount(self.guesses[own], minlength=GUESSES)
                counts[0] = 0
                yield self.net.logit(self.vectors[own]), int(counts.argmax()) if counts.any() else 0

    def scores(self, texts: pa.Array) -> Iterator[float]:
        for logit, language in self.logits(texts):
            yield float(1 / (1 + np.exp(-np.clip(logit - self.net.thresholds[language], -500, 500))))


# ---- on tables ----------------------------------------------------------------------------------------------------


def learnable(labels: DataFrame, divisor: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, toxic`` of the labels whose crc32 of ``doc_id`` modulo ``divisor`` isn't ``held``. A document labelled both ways is toxic."""
    own = labels.where((remainder(F.col("doc_id"), divisor) != held) & F.col("toxic").isNotNull())
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))


def drawn(own: DataFrame, sample: int, spare: bool) -> Column:
    """Whether a row of ``learnable`` is to be learned from: about ``sample`` of either label, by a hash of ``doc_id``.

    With ``spare``, one in ``CALIBRATION`` rows isn't, whatever their number. All bits of the hash count, so the number drawn
    does not grow with the table.
    """
    key, top = F.col("doc_id").cast("string"), 2**63 - 1
    open_ = F.pmod(F.xxhash64(key, F.lit("calibration")), F.lit(CALIBRATION)) != 0 if spare else F.lit(True)
    found = F.lit(False)
    for k, n in own.where(open_).groupBy("toxic").count().collect():
        within = F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(top if n <= sample else sample * top // n).cast("long")
        found = found | ((F.col("toxic") == k) & within)
    return open_ & found


class Sample(NamedTuple):
    """What ``fit`` learns from."""

    known: np.ndarray
    words: Words
    texts: list[np.ndarray]
    labels: list[int]


def numbered(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of ``own`` among the sorted ``words``, from 1; 0 for those that aren't there."""
    at = np.searchsorted(words, own)
    there = at < len(words)
    there[there] = words[at[there]] == own[there]
    return np.where(there, at + 1, 0).astype(np.int32)


def encodings(texts: pa.Array) -> pa.StructArray:
    """For each text its distinct words, as a hash and the hashes of their parts, and the text as numbers of these words."""
    # Kept as numbers in arrays: lists of Python's own would take ten times the memory.
    hashes, parts, counts, orders, distinct = [], [], [], [], []
    for text in texts:
        words = letters(text.as_py().lower())
        places = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = [features(w) for w in places]
        hashes.append(np.array([xxhash.xxh64_intdigest(w) for w in places], np.uint64).view(np.int64))
        parts.append(np.array([h for p in found for h in p], np.int32))
        counts.append(np.array(list(map(len, found)), np.int32))
        orders.append(np.array([places[w] for w in words], np.int32))
        distinct.append(len(places))

    def lists(sizes: np.ndarray | list[int], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32), values)

    def flat(arrays: list[np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate([*arrays, np.zeros(0, kind)], dtype=kind)

    words = pa.StructArray.from_arrays([pa.array(flat(hashes, np.int64)), lists(flat(counts, np.int32), pa.array(flat(parts, np.int32)))], names=["word", "parts"])
    return pa.StructArray.from_arrays([lists(distinct, words), lists([len(o) for o in orders], pa.array(flat(orders, np.int32)))], names=["words", "order"])


def labelled_sample(docs: DataFrame, own: DataFrame) -> Sample:
    """Texts and labels of the documents that ``own`` has, which are few, in order of ``doc_id``.

    Rows with the same ``doc_id`` and text count once. Words go by a hash of 64 bits, and reach the driver once each, with
    their parts that are in enough documents; the texts do as numbers of words. All words without such parts are word 0.
    """
    # At most about 2 * sample rows, so this side may be broadcast.
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(own), "doc_id").distinct()

    @F.arrow_udf("struct<words:array<struct<word:long,parts:array<int>>>,order:array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield encodings(texts)

    rows = stored(rows.select("doc_id", "toxic", F.xxhash64("text").alias("hash"), encode("text").alias("e")).select("doc_id", "toxic", "hash", "e.*"))
    common = rows.select(F.explode(F.array_distinct(F.flatten("words.parts"))).alias("part")).groupBy("part").count().where(F.col("count") >= LEAST_DOCUMENTS)
    known = np.sort(common.select("part").toArrow()["part"].to_numpy())
    flags = np.zeros(BUCKETS, bool)
    flags[known] = True
    sent = docs.sparkSession.sparkContext.broadcast(flags)  # bounded: one flag for each bucket

    def embeddable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = batch["parts"].flatten().to_numpy(), pc.list_value_length(batch["parts"]).to_numpy()
            good = sent.value[parts]
            ends = np.append(0, np.cumsum(good))[np.append(0, np.cumsum(sizes))]
            some = ends[1:] > ends[:-1]
            kept = pa.ListArray.from_arrays(np.append(0, ends[1:][some]).astype(np.int32), pa.array(parts[good]))
            yield pa.RecordBatch.from_arrays([batch["word"].filter(pa.array(some)), kept], names=["word", "parts"])

    entries = rows.select(F.explode("words").alias("w")).groupBy("w.word").agg(F.min("w.parts").alias("parts"))
    # In one pass of Python: a filter on a column that Python makes would make it twice, by twice the workers.
    entries = entries.mapInArrow(embeddable, "word long, parts array<int>").toArrow().sort_by("word").combine_chunks()
    sizes = pc.list_value_length(entries["parts"]).to_numpy()
    parts = pc.list_flatten(entries["parts"]).to_numpy()
    words = Words(np.append(np.int32(0), rows_of(known)[parts]), np.append(1, sizes))
    hashes = docs.sparkSession.sparkContext.broadcast(entries["word"].to_numpy())  # bounded: the words of the sample

    @F.arrow_udf("array<int>")
    def number(own: pa.Array, order: pa.Array) -> pa.Array:
        return pa.array([numbered(hashes.value, w.values.to_numpy())[o.values.to_numpy()] for w, o in zip(own, order)], pa.list_(pa.int32()))

    found = rows.select("doc_id", "toxic", "hash", number("words.word", "order").alias("order")).toArrow()
    # Views of the table's memory, in a fixed order.
    order = pc.sort_indices(found, [("doc_id", "ascending"), ("hash", "ascending")]).to_pylist()
    texts, toxic = [x.values.to_numpy() for x in found["order"]], found["toxic"].to_pylist()
    return Sample(known, words, [texts[i] for i in order], [toxic[i] for i in order])


def fitted(docs: DataFrame, own: DataFrame, sample: int) -> tuple[ConvNet, Column, np.ndarray]:
    """A net without thresholds, which rows of ``own`` it was learned from, and how many of either label."""
    for spare in (True, False):
        chosen = drawn(own, sample, spare)
        found = labelled_sample(docs, own.where(chosen))
        if len(set(found.labels)) == 2:
            break
    learned = np.bincount(found.labels, minlength=2) if found.labels else np.zeros(2, int)
    return fit(*found), chosen, learned


def told(text: Column, net: ConvNet, docs: DataFrame) -> Column:
    """Logit and guessed language of a text column of ``docs``; a NULL text is an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded: see SAMPLE

    @F.arrow_udf("struct<logit:double,language:int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer.of(sent.value)
        for texts in batches:
            found = list(scorer.logits(texts))
            yield pa.StructArray.from_arrays([pa.array([z for z, _ in found], pa.float64()), pa.array([k for _, k in found], pa.int32())], names=["logit", "language"])

    return run(text)


def counted(rows: DataFrame, own: DataFrame) -> np.ndarray:
    """Rows ``toxic, language, bin, n``: how many documents that ``own`` has fall in each bin of logits.

    ``rows`` has ``doc_id, hash`` (of the text; NULL without one) and ``told``. Rows with the same ``doc_id`` and text count
    once. The result is bounded by the number of bins.
    """
    logit = F.greatest(F.least(F.col("told.logit"), F.lit(float(FARTHEST))), F.lit(float(-FARTHEST)))
    found = rows.where("doc_id is not null and hash is not null")
    found = found.select("doc_id", "hash", F.col("told.language").alias("language"), F.floor(logit * BINS).cast("long").alias("bin"))
    counts = found.join(own, "doc_id").distinct().groupBy("toxic", "language", "bin").count().toArrow()
    return np.stack([c.to_numpy().astype(np.int64) for c in counts.columns], axis=1).reshape(-1, 4)


def settle(net: ConvNet, rows: DataFrame, own: DataFrame, chosen: Column, learned: np.ndarray) -> None:
    """Thresholds from all learnable rows that the net was not learned from; where one label has none, from all."""
    if learned.min() == 0:
        return
    counts = counted(rows, own.where(~chosen))
    if set(counts[:, 0].tolist()) != {0, 1}:
        counts, learned = counted(rows, own), np.zeros(2, int)
    calibrate(net, counts, learned)


def hashed(text: str = "text") -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("hash")


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ConvNet:
    """A net fitted to about ``sample`` documents of either label; its thresholds are from all others that are learnable.

    Where too few are labelled for both, all labelled rows serve for both. Labels are told apart by ``doc_id``; repeated rows
    of a document count once, and a document labelled both ways is toxic. To score the documents learned from, ``classify``
    does so in the same pass.
    """
    own = learnable(labels)
    net, chosen, learned = fitted(docs, own, sample)
    settle(net, docs.select("doc_id", hashed(), told(F.col("text"), net, docs).alias("told")), own, chosen, learned)
    return net


def score_of(told: Column, net: ConvNet) -> Column:
    """The score of a logit and language: 0.5 at the language's threshold."""
    shifted = told["logit"] - F.get(number_array(map(float, net.thresholds)), told["language"])
    return 1 / (1 + F.exp(-F.greatest(F.least(shifted, F.lit(500.0)), F.lit(-500.0))))


def classify(docs: DataFrame, labels: DataFrame, kept: list[str], column: str = "score", sample: int = SAMPLE) -> DataFrame:
    """The columns ``kept`` of ``docs`` and a score for each row, by a net learned from the labels.

    Every text is convolved once: logits and guessed languages are written beside the kept columns to the shared folder; the
    thresholds are counted from them and applied to them. A NULL text is an empty one; repeated rows are scored alike.
    """
    own = learnable(labels)
    net, chosen, learned = fitted(docs, own, sample)
    names = {c: fresh(docs, c) for c in ("hash", "told")}
    rows = docs.select(*[docs[c] for c in kept], docs["doc_id"].alias(fresh(docs, "key")), hashed().alias(names["hash"]), told(docs["text"], net, docs).alias(names["told"]))
    rows = stored(rows)
    narrow = rows.select(F.col(fresh(docs, "key")).alias("doc_id"), F.col(names["hash"]).alias("hash"), F.col(names["told"]).alias("told"))
    settle(net, narrow, own, chosen, learned)
    return rows.select(*[rows[c] for c in kept], score_of(F.col(names["told"]), net).alias(column))


def score_toxicity(docs: DataFrame, net: ConvNet, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``; ``predicted`` is 1 from a score of 0.5.

    A NULL text is scored as an empty one, repeated rows alike; rows with NULL identifiers stay.
    """
    found = docs.select(docs[id_column].alias("doc_id"), score_of(told(docs[text_column], net, docs), net).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
