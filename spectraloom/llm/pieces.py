"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

The pieces that fit a text form a lattice; a segmentation's score is the sum of its pieces' scores. The forward pass
(Viterbi) gives the best score up to each place. It is the exact heuristic of an A* search that runs backward from the end,
so segmentations come out in order, best first, and only as many open paths are kept as results are still wanted.

Where no piece spans two neighbouring bytes the lattice has a single node. Texts are cut at all such places into units,
and each distinct unit is searched once. A text's n best segmentations exchange the segmentation of a few units only: of the
n - 1 units whose second best is nearest to the best, which are searched in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.units import Lists, UnitTable, between, blocks, grown, kept

N = 3
#: Ids remembered for known units; beyond that all are forgotten.
KNOWN_IDS = 10_000_000
#: No UTF-8 text has this byte.
SEPARATOR = b"\xff"
#: What a character without a piece costs more than the least piece.
UNKNOWN_PENALTY = 10.0

#: Neither a piece nor the beginning of one.
ABSENT = object()

Segmentation = tuple[float, list[int]]


class Pieces:
    """The pieces of a model file, and the units' segmentations found so far."""

    def __init__(self, path: str, n: int = N):
        from sentencepiece import SentencePieceProcessor

        self.model, self.n = SentencePieceProcessor(model_file=path), n
        own = [i for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        # A space stands for the model's space mark.
        self.ids = {self.model.id_to_piece(i).replace("▁", " "): i for i in own}
        self.scores = {piece: self.model.get_score(i) for piece, i in self.ids.items()}
        # Beginnings of pieces are in here as well, without a score.
        self.begun = {piece[:k]: None for piece in self.ids for k in range(1, len(piece))} | {p: (s, self.ids[p]) for p, s in self.scores.items()}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        joined = np.zeros((256, 256), bool)
        joined[:, 0x80:0xC0] = True  # within a character
        for piece in self.ids:
            data = piece.encode()
            joined[list(data[:-1]), list(data[1:])] = True
        joined[0xFF, :] = joined[:, 0xFF] = False
        self.units, self.lists = UnitTable(between(joined), self.learn), Lists()
        self.forget()

    @classmethod
    def of(cls, path: str, n: int) -> Pieces:
        return kept((cls, path, n), lambda: cls(path, n))

    def forget(self) -> None:
        self.units.forget()
        self.lists.clear()
        # By unit the n best scores, -inf where there are fewer; their ids are the lists n * unit, n * unit + 1, ...
        self.scored = np.zeros((1 << 14, self.n))

    # ---- one lattice ----------------------------------------------------------------------------------------------

    def edges(self, text: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """The forward pass: the best score up to each place, and the edges that end there as start, score and id.

        A character without a piece is an edge of its own, with id -1.
        """
        size, look = len(text), self.begun.get
        best, arriving = [0.0] + [-np.inf] * size, [[] for _ in range(size + 1)]
        for start in range(size):
            here = best[start]
            for end in range(start + 1, size + 1):
                piece = look(text[start:end], ABSENT)
                if piece is None or piece is ABSENT:
                    if end == start + 1:
                        arriving[end].append((start, self.unknown, -1))
                        best[end] = max(best[end], here + self.unknown)
                    if piece is ABSENT:
                        break
                    continue
                score, number = piece
                arriving[end].append((start, score, number))
                if here + score > best[end]:
                    best[end] = here + score
        return best, arriving

    def search(self, text: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations, or all if there are fewer; equal scores in a fixed order."""
        ahead, arriving = self.edges(text)
        found, tie = [], 0
        # Open paths from some place to the end: each leads to a segmentation with exactly the score it is sorted by, so
        # no more are needed than results are wanted.
        paths, wanted = [(-ahead[-1], 0, len(text), 0.0, None)], n
        while paths and wanted:
            _, _, end, behind, path = paths.pop(0)
            if end == 0:
                found.append((behind, self.numbers(text, path)))
                wanted -= 1
                continue
            for start, score, number in arriving[end]:
                score += behind
                total = -(ahead[start] + score)
                if len(paths) < wanted or total < paths[-1][0]:
                    tie += 1
                    insort(paths, (total, tie, start, score, (number, start, path)))
                    del paths[wanted:]
        return found

    def numbers(self, text: str, path) -> list[int]:
        ids = []
        while path is not None:
            number, start, path = path
            if number < 0:
                ids += [self.bytes[b] for b in text[start].encode()]
            else:
                ids.append(number)
        return ids

    # ---- whole texts ----------------------------------------------------------------------------------------------

    def learn(self, units: list[bytes]) -> np.ndarray:
        found = [[(0.0, [])] if u == SEPARATOR else self.search(u.decode(), self.n) for u in units]
        found = [f + [(-np.inf, [])] * (self.n - len(f)) for f in found]
        numbers = self.lists.add([ids for f in found for _, ids in f])[:: self.n] // self.n
        self.scored = grown(self.scored, self.lists.size // self.n)
        self.scored[numbers] = [[score for score, _ in f] for f in found]
        return numbers

    def normalized(self, text: str) -> str:
        return self.model.normalize(text).replace("▁", " ")

    def encode(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its best segmentations: scores and ids."""
        for data, begins in blocks(pa.array([self.normalized(t) for t in texts], pa.string()), separator=SEPARATOR):
            if self.lists.filled > KNOWN_IDS:
                self.forget()
            starts, ends = self.units.split(data)
            numbers = self.units.numbers(data, starts, ends)
            ids, after = self.lists.joined(numbers * self.n)
            after = np.append(0, after)
            stops = np.append(begins[1:] - 1, len(data))
            for a, b in zip(np.searchsorted(starts, begins).tolist(), np.searchsorted(starts, stops).tolist()):
                own = ids[after[a] : after[b]]
                yield self.ranked(numbers[a:b], own, after[a : b + 1] - after[a])

    def ranked(self, units: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The best segmentations of a text from those of its units."""
        scores, few = self.scored[units], self.n - 1
        gaps = scores[:, 0] - scores[:, 1] if few else np.zeros(0)
        nearest = np.argpartition(gaps, few - 1)[:few] if 0 < few < len(gaps) else np.arange(len(gaps) if few else 0)
        nearest = sorted((k for k in nearest.tolist() if gaps[k] < np.inf), key=lambda k: (gaps[k], k))
        lost: list[tuple[float, tuple]] = [(0.0, ())]
        for k in nearest:
            own = [(j, s) for j, s in enumerate(scores[k].tolist()) if j and s > -np.inf]
            more = [(loss + scores[k, 0] - s, (*changes, (k, j))) for loss, changes in lost for j, s in own]
            lost = sorted([*lost, *more])[: self.n]
        best = float(scores[:, 0].sum())
        return [(best - loss, self.changed(units, ids, bounds, changes)) for loss, changes in lost]

    def changed(self, units: np.ndarray, ids: np.ndarray, bounds: np.ndarray, changes: tuple) -> np.ndarray:
        parts, at = [], 0
        for k, j in sorted(changes):
            parts += [ids[at : bounds[k]], self.lists.joined(units[k : k + 1] * self.n + j)[0]]
            at = bounds[k + 1]
        return np.concatenate([*parts, ids[at:]]) if changes else ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


# ---- on tables ----------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, model: str, n: int = N, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """The best segmentations of every whole text, one row for each row of ``docs``.

    ``doc_id, n_ids, best_score, next_score, found, ids_sha256, round_trip`` and, with ``with_ids``, ``ids``: an array of
    ``score, ids``, best first. ``ids_sha256`` covers the ids of all of them in order (32 bits each, little-endian);
    ``next_score`` is NULL where there is a single segmentation. ``round_trip`` says that the best one decodes to the text. A
    NULL text is empty and has one empty segmentation. ``model`` is the path of a model file on every executor.
    """
    types = [("n_ids", pa.int64()), ("best_score", pa.float64()), ("next_score", pa.float64()), ("found", pa.int32()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]
    kinds = "n_ids:long,best_score:double,next_score:double,found:int,ids_sha256:string,round_trip:boolean"
    if with_ids:
        types.append(("ids", pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))))
        kinds += ",ids:array<struct<score:double,ids:array<int>>>"

    @F.arrow_udf(f"struct<{kinds}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces.of(model, n)
        for batch in batches:
            rows, texts = [], [t or "" for t in batch.to_pylist()]
            for text, found in zip(texts, pieces.encode(texts)):
                digest = hashlib.sha256(b"".join(ids.astype("<u4").tobytes() for _, ids in found)).hexdigest()
                score, best = found[0]
                same = pieces.decode(best.tolist()) == text.replace("▁", " ")
                row = (len(best), score, found[1][0] if len(found) > 1 else None, len(found), digest, same)
                rows.append(row + (([{"score": s, "ids": ids.tolist()} for s, ids in found],) if with_ids else ()))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[k for k, _ in types])

    return docs.select(docs[id_column].alias("doc_id"), run(docs[text_column]).alias("found")).select("doc_id", "found.*")


def decode(ids: Column, model: str) -> Column:
    """Texts of a column of id arrays; NULL where it is."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = Pieces.of(model, 1)
        for batch in batches:
            yield pa.array([None if row is None else pieces.decode(row) for row in batch.to_pylist()], pa.string())

    return run(ids)
