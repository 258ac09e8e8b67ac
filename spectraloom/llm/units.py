"""Splitting of UTF-8 texts into units (words, digits, runs of signs) and numbering of equal units, many at a time.

Most words of a corpus repeat, so per-word work is done once per distinct word and remembered. Looking words up one by one
would cost more than the work saved; here a batch of texts is one byte array, and its units are found and looked up with
array operations. The memory is a table with a fixed number of places: a word that meets another in its place takes over.
Keys hold the whole word, so no two words are ever mixed up.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, SIGN, GLUE = range(5)
#: Bytes handled together, about.
BLOCK = 1 << 20
#: Longer units have a dictionary of their own.
SHORT = 23


def byte_classes(glue: bytes = b"") -> np.ndarray:
    """Class of each byte. Units begin at every digit and where the class changes, but never beside a glue byte.

    Bytes beyond ASCII are glue, so units are whole characters.
    """
    table = np.full(256, SIGN, np.uint8)
    table[list(b" \t\n\v\f\r")] = SPACE
    table[list(b"0123456789")] = DIGIT
    table[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    table[128:] = GLUE
    table[list(glue)] = GLUE
    return table


Spans = tuple[np.ndarray, np.ndarray]


def by_classes(classes: np.ndarray) -> Callable[[bytes], Spans]:
    """Splitting at changes of class; white space is left out."""

    def split(data: bytes) -> Spans:
        kind = classes[np.frombuffer(data, np.uint8)]
        before = np.empty_like(kind)
        before[:1], before[1:] = SPACE, kind[:-1]
        new = ((kind != before) | (kind == DIGIT)) & (kind != SPACE)
        new &= ((kind != GLUE) & (before != GLUE)) | (before == SPACE)
        marks = np.flatnonzero(new | ((kind == SPACE) & (before != SPACE)))
        begins = new[marks]
        return marks[begins], np.append(marks[1:], len(data))[begins]

    return split


def between(joined: np.ndarray) -> Callable[[bytes], Spans]:
    """Splitting between all neighbouring bytes that are not ``joined`` (a table of both); nothing is left out."""

    def split(data: bytes) -> Spans:
        own = np.frombuffer(data, np.uint8)
        if not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.flatnonzero(~joined[own[:-1], own[1:]]) + 1
        return np.append(0, cuts), np.append(cuts, len(data))

    return split


class UnitTable:
    """Numbers of units. ``learn`` gets new units and returns their numbers."""

    def __init__(self, split: Callable[[bytes], Spans], learn: Callable[[list[bytes]], np.ndarray], slots: int = 1 << 20, long_units: int = 50_000):
        self.split, self.learn, self.slots, self.long_units = split, learn, slots, long_units
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys = [np.zeros(self.slots, np.uint64) for _ in range(3)]
        self.number = np.zeros(self.slots, np.int32)
        self.long: dict[bytes, int] = {}

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.frombuffer(data + bytes(32), np.uint8)
        words = np.ndarray(len(data) + 25, "<u8", padded.data, strides=(1,))
        size = ends - starts
        keys = [words[starts + 8 * k] & self.masks[np.clip(size - 8 * k, 0, 8 if k < 2 else 7)] for k in range(3)]
        keys[2] |= size.astype(np.uint64) << np.uint64(56)
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        place = ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)).astype(np.int64) % self.slots
        known = size <= SHORT
        for mine, theirs in zip(self.keys, keys):
            known &= mine[place] == theirs
        result = self.number[place].astype(np.int64)
        missing = np.flatnonzero(~known)
        if len(missing):
            units = [data[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())]
            found = {u: self.long.get(u, -1) for u in units}
            new = [u for u, k in found.items() if k < 0]
            learned = self.learn(new).tolist()
            found.update(zip(new, learned))
            if len(self.long) + len(new) > self.long_units:
                self.long.clear()
            self.long.update((u, k) for u, k in zip(new, learned) if len(u) > SHORT)
            result[missing] = [found[u] for u in units]
            short = missing[size[missing] <= SHORT]
            # Where two units share a place, one of them fills all columns.
            _, last = np.unique(place[short][::-1], return_index=True)
            keep = short[::-1][last]
            for mine, theirs in zip(self.keys, keys):
                mine[place[keep]] = theirs[keep]
            self.number[place[keep]] = result[keep]
        return result


KEPT: list[tuple] = []


def kept(key: tuple, make: Callable):
    """What ``make`` made for this key in this Python worker. Only the latest is kept, which bounds a worker's memory."""
    if not KEPT or KEPT[0][0] != key:
        KEPT.clear()
        gc.collect()  # tables and their owners refer to each other
        KEPT.append((key, make()))
    return KEPT[0][1]


class Lists:
    """Lists of small numbers, one after another."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.values, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.counts, self.begins, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, lists: list) -> np.ndarray:
        """The numbers of these lists."""
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), "<u4", counts.sum())
        self.values, self.size = grown(self.values, self.filled + len(flat)), self.size + len(lists)
        self.counts, self.begins = grown(self.counts, self.size), grown(self.begins, self.size)
        numbers = np.arange(self.size - len(lists), self.size)
        self.counts[numbers], self.begins[numbers] = counts, self.filled + np.cumsum(counts) - counts
        self.values[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        return numbers

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These lists in a row, and where each one ends."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        return self.values[np.repeat(self.begins[numbers] - (ends - counts), counts) + np.arange(counts.sum())], ends


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for ``size`` elements along its first axis."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros((max(size, 2 * len(array)) - len(array), *array.shape[1:]), array.dtype)])


def blocks(texts: pa.Array, size: int = BLOCK, separator: bytes = b"\n") -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts (NULL: empty) joined to blocks of about ``size`` bytes, and where each one begins."""
    joined, begins, at = [], [], 0
    few = (texts.slice(i, 100).cast(pa.binary()).to_pylist() for i in range(0, len(texts), 100))
    for text in chain.from_iterable(few):
        text = text or b""
        joined.append(text)
        begins.append(at)
        at += len(text) + 1
        if at >= size:
            yield separator.join(joined), np.array(begins)
            joined, begins, at = [], [], 0
    if joined:
        yield separator.join(joined), np.array(begins)
