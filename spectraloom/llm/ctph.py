"""Context-triggered piecewise hashing of documents.

A hash rolling over seven bytes ends a chunk wherever its low bits are all ones; each chunk leaves one character, a hash of
its content. An edit changes the chunks around it only. The block size, a power of two, follows from the text's length,
so that a signature has about 64 characters; a second one has twice that block size. A chunk is half the block size long at
least, so that 128 characters cover the whole text also where triggers recur. Signatures of equal block sizes are compared
by their edit distance (insertions and deletions).

For comparing a document with the next one, documents are dealt out by ranges of their identifiers, cut at identifiers
that occur. The first document of a range is dealt to the range before it as well, so every document meets its successor
in one task, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLLING = 7
TARGET = 64
#: Texts have no more chunks, as these have at least ``1 / SHORTEST`` of a block.
SHORTEST = 2
LONGEST = SHORTEST * TARGET
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signatures of unlike texts have about so much in common: this share in long ones, half of it at ``CHANCE_LENGTH``.
CHANCE, CHANCE_LENGTH = 0.22, 16
#: Bytes hashed together, to bound memory.
BLOCK = 1 << 20
#: A chunk is ended after so many times the block size in any case: repeated lines may have no trigger at all.
WIDEST = 4
#: An odd weight for each place of the rolling window.
WEIGHTS = [pow(0x9E3779B1, k + 1, 1 << 32) for k in range(ROLLING)]


def triggers(data: bytes, block: int) -> np.ndarray:
    """Ends (exclusive) of the chunks at this block size."""
    found = []
    for begin in range(0, len(data), BLOCK):
        lead = min(begin, ROLLING - 1)
        own = np.frombuffer(data, np.uint8)[begin - lead : begin + BLOCK].astype(np.uint32) + np.uint32(1)
        rolling = own * np.uint32(WEIGHTS[0])
        for k in range(1, ROLLING):
            rolling[k:] += own[:-k] * np.uint32(WEIGHTS[k])
        rolling ^= rolling >> np.uint32(16)
        rolling *= np.uint32(0x85EBCA6B)
        rolling ^= rolling >> np.uint32(13)
        ends = np.flatnonzero((rolling[lead:] & np.uint32(block - 1)) == np.uint32(block - 1))
        found.append(ends + begin + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def with_forced_ends(ends: np.ndarray, size: int, widest: int) -> np.ndarray:
    starts, stops = np.append(0, ends), np.append(ends, size)
    wide = np.flatnonzero(stops - starts > widest)
    if not len(wide):
        return ends
    forced = [np.arange(a + widest, b, widest) for a, b in zip(starts[wide].tolist(), stops[wide].tolist())]
    return np.sort(np.concatenate([ends, *forced]))


def spaced(ends: np.ndarray, least: int) -> np.ndarray:
    """Those of the ends that are ``least`` bytes or more after the last one kept, or the start."""
    kept, at = [], int(np.searchsorted(ends, least))
    while at < len(ends):
        kept.append(int(ends[at]))
        at = int(np.searchsorted(ends, kept[-1] + least))
    return np.array(kept, np.int64)


def signature(data: bytes, ends: np.ndarray, block: int) -> str:
    """One character for each chunk of the whole text."""
    ends = with_forced_ends(spaced(ends, max(1, block // SHORTEST)), len(data), WIDEST * block).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    starts = [0, *ends[:-1]]
    return "".join([ALPHABET[xxhash.xxh32_intdigest(data[a:b]) & 63] for a, b in zip(starts, ends)]) if data else ""


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``. Equal texts have equal fingerprints."""
    data = text.encode()
    block = 1
    while len(data) > block * TARGET:
        block *= 2
    ends = triggers(data, block)
    return f"{block}:{signature(data, ends, block)}:{signature(data, triggers_of_double(data, ends, block), 2 * block)}"


def triggers_of_double(data: bytes, ends: np.ndarray, block: int) -> np.ndarray:
    """Ends at twice the block size: those of the ends whose next bit is one as well."""
    if not len(ends):
        return ends
    kept = []
    for begin in range(0, len(ends), BLOCK):
        at = ends[begin : begin + BLOCK] - 1
        rolling, own = np.zeros(len(at), np.uint32), np.frombuffer(data, np.uint8)
        for k in range(ROLLING):
            inside = at >= k
            rolling[inside] += (own[at[inside] - k].astype(np.uint32) + np.uint32(1)) * np.uint32(WEIGHTS[k])
        rolling ^= rolling >> np.uint32(16)
        rolling *= np.uint32(0x85EBCA6B)
        rolling ^= rolling >> np.uint32(13)
        kept.append(at[(rolling & np.uint32(2 * block - 1)) == np.uint32(2 * block - 1)] + 1)
    return np.concatenate(kept)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def signatures_alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) over the lengths together, above what chance gives, from 0 to 1.

    The edit distance counts for every pair; 0 where just one signature is empty.
    """
    if a == b:
        return 1.0
    share = 2 * common_length(a, b) / (len(a) + len(b))
    short = min(len(a), len(b))
    chance = CHANCE * short / (short + CHANCE_LENGTH)
    return max(0.0, (share - chance) / (1 - chance))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best over the block sizes both fingerprints have. Equal fingerprints: 1."""
    if a == b:
        return 1.0
    (size_a, *of_a), (size_b, *of_b) = a.split(":"), b.split(":")
    by_size = {int(size_a): of_a[0], 2 * int(size_a): of_a[1]}
    theirs = {int(size_b): of_b[0], 2 * int(size_b): of_b[1]}
    return max((signatures_alike(s, theirs[size]) for size, s in by_size.items() if size in theirs), default=0.0)


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as much of the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


# ---- on tables ----------------------------------------------------------------------------------------------------


def fingerprints(text: Column) -> Column:
    """Fingerprints of whole texts; NULL counts as empty."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t or "") for t in texts.to_pylist()], pa.string())

    return run(text)


def alike(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; NULL if either is."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = zip(left.to_pylist(), right.to_pylist())
            yield pa.array([None if x is None or y is None else likeness(x, y) for x, y in pairs], pa.float64())

    return run(a, b)


def range_cuts(docs: DataFrame, ranges: int) -> list[int]:
    """Identifiers at which the ranges end, ascending; the last one is the largest of all."""
    shares = [i / ranges for i in range(1, ranges + 1)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * ranges).alias("cuts"), F.max("doc_id").alias("last")).first()
    return sorted({*(found["cuts"] or []), found["last"]} - {None})


def dealt(docs: DataFrame, cuts: list[int], ranges: int) -> DataFrame:
    """``range, guest`` for each row; the last row of a range is a guest of the next one, where it follows the smallest."""
    limits, places = np.array(cuts, np.int64), "array<struct<range:long,guest:boolean>>"

    @F.arrow_udf(places)
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            own = np.searchsorted(limits, ids.fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            rows = []
            for i, place in zip(ids.to_pylist(), own):
                guest = [{"range": (place + 1) % len(cuts), "guest": True}] if i == cuts[min(place, len(cuts) - 1)] else []
                rows.append(None if i is None else [{"range": place, "guest": False}, *guest])
            yield pa.array(rows, pa.list_(pa.struct([("range", pa.int64()), ("guest", pa.bool_())])))

    # Rows without an identifier have no successor, so they may go anywhere.
    alone = F.array(F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(ranges))).alias("range"), F.lit(False).alias("guest")))
    return docs.withColumn("place", F.explode(F.coalesce(place("doc_id") if cuts else F.lit(None).cast(places), alone))).select("doc_id", "text", "place.*")


def compare_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike the document is to that and to the next one.

    The next document is the one with the next smaller ``doc_id``, after the last the first; rows with the same ``doc_id``
    follow one another by text. A NULL text is empty. A row without ``doc_id`` has no place in the order: it is its own
    successor. Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt(docs, range_cuts(docs, ranges), ranges)
    order = placed.repartition("range").sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    def compared(doc, text: str, mark: str, following: str, next_mark: str) -> tuple:
        changed = edited(text, following)
        new = fingerprint(changed)
        return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, new, likeness(mark, new), likeness(mark, next_mark)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before = None
        for doc, text, place, guest in rows(batches):
            if doc is None:
                mark = fingerprint(text)
                yield compared(doc, text, mark, text, mark)
                continue
            if guest and (before is None or before[2] != place or before[3]):
                continue  # a further copy of the guest
            mark = fingerprint(text)
            if before is not None and before[2] == place:
                yield compared(before[0], before[1], before[4], text, mark)
            before = doc, text, place, guest, mark

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for row in results(batches):
            kept.append(row)
            if len(kept) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return order.mapInArrow(run, kinds)
