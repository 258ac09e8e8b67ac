"""Packing of tokenized documents into windows: best-fit decreasing over a segment tree of remaining capacities.

A document longer than a window is first cut into full windows; what remains of each document is an item. Items are taken
from the longest to the shortest, each into the open window with the least room that suffices. The few windows that stay
loosely filled at the end are cut anew: their contents are joined and cut into full windows, and the last of those into
lengths that are powers of two, which need no padding.

Tasks pack what they read, a bounded number of tokens at a time, so nothing is shuffled and documents of a hot source
weigh nothing special. Sequence numbers carry the task's number: a task that runs again after a loss writes the same.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spectraloom.llm.units import Lists, UnitTable, blocks, by_classes, byte_classes, kept

WINDOW = 2048
END_ID = 1
#: Tokens packed together; bounds a task's memory.
GROUP_TOKENS = 8_000_000
#: Windows with more room than this at the end are cut anew.
SLACK = 16

#: Ids remembered for known units; beyond that all are forgotten.
KNOWN_IDS = 4_000_000


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never looks across it.

    It also never joins ASCII letters, digits and signs to one another, apart from an apostrophe and letters, so units
    between such places are encoded once (``units``). The tokens its file adds, such as an end of text, are found before all
    that: a text in which one occurs is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units, self.ids = UnitTable(by_classes(byte_classes(glue=b"'")), self.learn), Lists()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        return kept((cls, path), lambda: cls(path))

    def forget(self) -> None:
        self.units.forget()
        self.ids.clear()

    def learn(self, units: list[bytes]) -> np.ndarray:
        model, plain = self.tokenizer.model, list(map(plain_piece, units))
        found = [[t.id for t in model.tokenize(p)] if p else None for p in plain]
        rest = iter(self.tokenizer.encode_batch_fast([u.decode() for u, p in zip(units, plain) if not p], add_special_tokens=False))
        return self.ids.add([next(rest).ids if ids is None else ids for ids in found])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = self.with_added(texts)
        for at, ids in enumerate(self.by_units(texts)):
            yield np.array(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids, "<u4") if at in whole else ids

    def with_added(self, texts: pa.Array) -> set[int]:
        """Places of the texts that hold an added token, in whatever case."""
        found = (pc.match_substring(texts, token, ignore_case=True) for token in self.added)
        return {i for hits in found for i in pc.indices_nonzero(pc.fill_null(hits, False)).to_pylist()}

    def by_units(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for data, begins in blocks(texts):
            if self.ids.filled > KNOWN_IDS:
                self.forget()
            data = data.lower()  # bytes.lower: ASCII only
            starts, ends = self.units.split(data)
            ids, after = self.ids.joined(self.units.numbers(data, starts, ends))
            bounds = np.append(0, after)[np.searchsorted(starts, np.append(begins, len(data) + 1))]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield ids[a:b]


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level tokenizers name bytes: printable bytes name themselves, others come after 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def plain_piece(unit: bytes) -> str | None:
    """The unit in the letters of the tokenizer's vocabulary, if it is a single piece for sure.

    That holds for ASCII without apostrophe, and for words of composed Latin letters.
    """
    if unit.isascii():
        return None if b"'" in unit else unit.decode().translate(BYTE_LETTERS)
    word = unit.decode().lower()
    if word.isalpha() and max(word) < "\u0250" and is_normalized("NFC", word):
        return word.encode().decode("latin-1").translate(BYTE_LETTERS)
    return None


class OpenWindows:
    """Open windows by remaining room. A node of the tree counts the windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += by
            node >>= 1

    def add(self, room: int, number: int) -> None:
        if room:
            self.by_room[room].append(number)
            self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of ``need`` or more: its room and number."""
        counts, node = self.counts, self.leaves + need
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.by_room[room].pop()


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Items by window: best fit, from the longest item to the shortest; equal ones in their order."""
    tree, windows = OpenWindows(window), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[item])
        if found is None:
            found = window, len(windows)
            windows.append([])
        room, number = found
        windows[number].append(item)
        tree.add(room - lengths[item], number)
    return windows


def cut_lengths(total: int, window: int) -> list[int]:
    """Full windows, then powers of two from the largest."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def lay_out(lengths: list[int], window: int, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in it, length). Every token of every item lies in one piece."""
    sequences, loose = [], []
    for items in best_fit(lengths, window):
        filled = sum(lengths[i] for i in items)
        if window - filled <= slack or filled & (filled - 1) == 0:
            sequences.append([(i, 0, lengths[i]) for i in items])
        else:
            loose += items
    todo = iter([(i, lengths[i]) for i in loose])
    item, left = next(todo, (0, 0))
    for room in cut_lengths(sum(lengths[i] for i in loose), window):
        pieces = []
        while room:
            if not left:
                item, left = next(todo)
            taken = min(room, left)
            pieces.append((item, lengths[item] - left, taken))
            room, left = room - taken, left - taken
        sequences.append(pieces)
    return sequences


class Packer:
    """Packs the documents of one task."""

    def __init__(self, names: pa.Schema, window: int, first: int, with_ids: bool):
        self.schema, self.window, self.with_ids = names, window, with_ids
        self.numbers, self.rows, self.rests, self.tokens = count(first), [], [], 0

    def row(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
        self.rows.append((doc, start, len(ids), crc, total, sequence, offset) + ((ids.tolist(),) if self.with_ids else ()))

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self.row(doc, start, ids[start : start + self.window], total, next(self.numbers), 0)
        if whole < total:
            self.rests.append((doc, whole, ids[whole:].copy(), total))
            self.tokens += total - whole

    def close(self) -> None:
        for pieces in lay_out([len(r[2]) for r in self.rests], self.window):
            number, offset = next(self.numbers), 0
            for item, start, length in pieces:
                doc, before, ids, total = self.rests[item]
                self.row(doc, before + start, ids[start : start + length], total, number, offset)
                offset += length
        self.rests, self.tokens = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pack(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    ``tokenizer`` is the path of a tokenizer file on every executor. Every document ends with ``end_id``, so an empty or
    NULL text has one token. Repeated rows, and rows with NULL identifiers, are packed as documents of their own.
    """
    kinds = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    docs = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    result = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end = WordTokenizer.of(tokenizer), None, np.array([end_id], "<u4")
        for batch in batches:
            if packer is None:
                fields = [pa.field("doc_id", batch.schema.field(0).type)] + [pa.field(k.split()[0], pa.int64()) for k in kinds.split(", ")[:6]]
                fields += [pa.field("ids", pa.list_(pa.int32()))] * with_ids
                packer = Packer(pa.schema(fields), window, TaskContext.get().partitionId() << 40, with_ids)
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1))):
                packer.add(doc, np.concatenate([ids, end]))
                if packer.tokens >= group_tokens:
                    packer.close()
            yield packer.batch()
        if packer is not None:
            packer.close()
            yield packer.batch()

    return docs.mapInArrow(run, result)
