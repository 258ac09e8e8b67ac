"""Language identification, words first.

A known word adds its log frequency in each language. An unseen word is read as character n-grams: the longest known one at
each place, from four characters down to one, with the same kind of log frequencies. The language with the largest sum wins.

The tables are learned from a bounded sample of labelled documents (``SAMPLE`` for each language, by a hash of ``doc_id``);
every document is then scored, over its whole text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import remainder
from spectraloom.llm.units import SPACE, UnitTable, blocks, by_classes, byte_classes, grown, kept

#: About so many documents of each language are learned from.
SAMPLE = 2000
#: The most frequent words of each language that are kept, where they fit the budget below.
WORDS = 20_000
#: A model has a number for each word and language: so many in all, spread evenly over the languages.
NUMBERS = 16_000_000
#: But so many words of each language in any case.
LEAST_WORDS = 50
LONGEST_GRAM = 4
UNKNOWN = "und"
#: Added to every count.
SMOOTHING = 0.1
#: Units remembered by a task.
REMEMBERED = 250_000

WORD = re.compile(r"[^\W\d_]+")


def word_classes() -> np.ndarray:
    """Only letters make units here."""
    classes = byte_classes()
    classes[:128] = np.where(classes[:128] == 1, 1, SPACE)
    return classes


class Logs:
    """Log frequencies of items by language, as rows of one table."""

    def __init__(self, languages: list[str], counts: dict[str, Counter]):
        items = sorted(set().union(*counts.values())) if counts else []
        self.places = {x: i for i, x in enumerate(items)}
        table = np.array([[counts[name][x] for name in languages] for x in items], float).reshape(len(items), len(languages)) + SMOOTHING
        self.table = np.log(table / table.sum(axis=0)) if items else table

    def __len__(self) -> int:
        return len(self.places)

    def __contains__(self, item: str) -> bool:
        return item in self.places

    def __getitem__(self, item: str) -> np.ndarray:
        return self.table[self.places[item]]

    def get(self, item: str) -> np.ndarray | None:
        at = self.places.get(item)
        return None if at is None else self.table[at]


NOTHING = Logs([], {})


@dataclass
class LanguageModel:
    """Log frequencies by language, in the order of ``languages``, of words and of n-grams."""

    languages: list[str] = field(default_factory=list)
    words: Logs = NOTHING
    grams: list[Logs] = field(default_factory=lambda: [NOTHING] * LONGEST_GRAM)
    #: Distinct words of the sample that found no room; they are scored by their n-grams.
    left_out: int = 0

    @classmethod
    def of(cls, counts: dict[str, Counter]) -> LanguageModel:
        """From counts of words by language."""
        languages = sorted(counts)
        grams: list[dict[str, Counter]] = [{name: Counter() for name in languages} for _ in range(LONGEST_GRAM)]
        for name in languages:
            for word, n in counts[name].items():
                marked = f"^{word}$"
                for size in range(1, LONGEST_GRAM + 1):
                    own = grams[size - 1][name]
                    for i in range(len(marked) - size + 1):
                        own[marked[i : i + size]] += n
        return cls(languages, Logs(languages, counts), [Logs(languages, g) for g in grams])

    def backed_off(self, word: str) -> np.ndarray:
        """The sum over n-grams of an unseen word: at each place the longest known one."""
        marked, at, total = f"^{word}$", 0, np.zeros(len(self.languages))
        while at < len(marked):
            step = 1
            for size in range(min(LONGEST_GRAM, len(marked) - at), 0, -1):
                found = self.grams[size - 1].get(marked[at : at + size])
                if found is not None:
                    total, step = total + found, size
                    break
            at += step
        return total

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """Sums by language and number of words."""
        total, n = np.zeros(len(self.languages)), 0
        for word in letters(text.lower()):
            known = self.words.get(word)
            total, n = total + (self.backed_off(word) if known is None else known), n + 1
        return total, n


def letters(text: str) -> list[str]:
    """Words. The pattern also takes signs like a superscript two, which are no letters."""
    words = WORD.findall(text)
    return words if all(map(str.isalpha, words)) else ["".join(filter(str.isalpha, w)) for w in words if any(map(str.isalpha, w))]


class Scorer:
    """Scores of texts, with the sums of units remembered."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.units = UnitTable(by_classes(word_classes()), self.learn)
        self.forget()

    @classmethod
    def of(cls, model: LanguageModel) -> Scorer:
        return kept((cls, id(model)), lambda: cls(model))

    def forget(self) -> None:
        self.units.forget()
        self.rows, self.known = np.zeros((1 << 12, len(self.model.languages) + 1)), 0

    def learn(self, units: list[bytes]) -> np.ndarray:
        self.rows = grown(self.rows, self.known + len(units))
        numbers = np.arange(self.known, self.known + len(units))
        for k, unit in zip(numbers.tolist(), units):
            self.rows[k, :-1], self.rows[k, -1] = self.model.score(unit.decode())
        self.known += len(units)
        return numbers

    def sums(self, texts: pa.Array) -> np.ndarray:
        """By text: a sum for each language, then the number of words."""
        found = []
        for data, begins in blocks(texts):
            if self.known > REMEMBERED:
                self.forget()
            data = data.lower()  # bytes.lower: ASCII only, learn() does the rest
            starts, ends = self.units.split(data)
            numbers = self.units.numbers(data, starts, ends)  # may learn new rows
            bounds = np.searchsorted(starts, np.append(begins, len(data) + 1))
            # Each text by itself, so that its sum does not depend on its neighbours.
            totals, some = np.zeros((len(begins), self.rows.shape[1])), np.flatnonzero(np.diff(bounds))
            if len(some):
                totals[some] = np.add.reduceat(self.rows[numbers], bounds[some], axis=0)
            found.append(totals)
        return np.concatenate(found) if found else np.zeros((0, self.rows.shape[1]))


def verdicts(model: LanguageModel, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages, and the share of the best one's likelihood per square root of the words in that of all languages."""
    words, logs = np.round(sums[:, -1]), sums[:, :-1]
    if not model.languages:
        return [UNKNOWN] * len(sums), np.zeros(len(sums))
    best = logs.argmax(axis=1)
    scaled = (logs - logs.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words, 1))[:, None]
    score = np.where(words > 0, 1 / np.exp(scaled).sum(axis=1), 0.0)
    return [model.languages[b] if w else UNKNOWN for b, w in zip(best.tolist(), words.tolist())], score


# ---- on tables ----------------------------------------------------------------------------------------------------


def words_each(languages: int, words: int = WORDS, numbers: int = NUMBERS) -> int:
    """How many words of each language fit: a word takes a number for each language."""
    return min(words, max(LEAST_WORDS, numbers // languages**2))


def learn_languages(labelled: DataFrame, sample: int = SAMPLE, words: int = WORDS, numbers: int = NUMBERS) -> LanguageModel:
    """The model of rows ``doc_id, text, lang``; rows without any of the three teach nothing.

    Every language is learned. Words are counted by Spark; the driver gets the counts of the most frequent ones, as many of
    each language as ``words_each`` says, in the order of their counts and then of the words.
    """
    labelled = labelled.dropna(subset=["doc_id", "text", "lang"])
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel()
    top_hash = 2**63 - 1
    bounds = {str(r["lang"]): top_hash if r["count"] <= sample else sample * top_hash // r["count"] for r in sizes}
    # One literal, however many languages there are.
    bound = F.element_at(F.from_json(F.lit(json.dumps(bounds)), "map<string,bigint>"), F.col("lang").cast("string"))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 1) <= bound
    word = F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")
    counts = labelled.where(drawn).select("lang", word).where("word != ''").groupBy("lang", "word").count()
    order, kept = Window.partitionBy("lang").orderBy(F.desc("count"), "word"), words_each(len(sizes), words, numbers)
    counts = counts.withColumn("rank", F.row_number().over(order)).withColumn("distinct", F.count("word").over(Window.partitionBy("lang")))
    top = counts.where(F.col("rank") <= kept).select("lang", "word", "count", "rank", "distinct").toArrow()
    found: dict[str, Counter] = {r["lang"]: Counter() for r in sizes}
    left_out = 0
    for name, word, count, rank, distinct in zip(*(top[c].to_pylist() for c in top.column_names)):
        found[name][word] = count
        left_out += max(distinct - kept, 0) * (rank == 1)
    model = LanguageModel.of({name: own for name, own in found.items() if own})
    model.left_out = left_out
    return model


def predicted(text: Column, model: LanguageModel, docs: DataFrame) -> Column:
    """Struct ``lang_pred, score`` of a text column of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see learn_languages

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer.of(sent.value)
        for texts in batches:
            names, score = verdicts(scorer.model, scorer.sums(texts))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``.

    ``und`` with score 0 where a text is NULL or has no letter, or where nothing could be learned. Of languages that score
    alike the first by name is taken. Repeated rows are scored alike; rows with NULL identifiers stay.
    """
    found = predicted(docs[text_column], model, docs).alias("found")
    return docs.select(docs[id_column].alias("doc_id"), found).select("doc_id", "found.*")


def taught(docs: DataFrame, divisor: int = 3, held: int = 1) -> DataFrame:
    """Rows to learn from: crc32 of ``doc_id`` modulo ``divisor`` isn't ``held``."""
    return docs.where(remainder(F.col("doc_id"), divisor) != held)
