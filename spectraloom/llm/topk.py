"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors are cut into ``LISTS`` slices of components. For a query each slice is a list of local scores over all rows, and a
row's score is the sum of its local scores. The lists are spread over many tasks.

1. Every list gives up its ``head`` best entries. The rows among them are scored exactly; the k-th best score t is a safe
   cutoff: at least k rows reach it.
2. The cutoff goes out with the queries. A row that reaches t has a local score of at least t / LISTS in some list, so each
   list gives up all entries from there on. The k-th best score among rows seen in all lists may raise t. A row that cannot
   reach it, its missing local scores taken at the bound, goes.
3. Missing local scores of the rest are looked up, and the best k remain.

Queries meet rows in blocks of bounded size: row blocks stay where they are, each block of queries visits all of them in
the first two phases, and in the third only those that hold a missing score. Of large tables blocks are larger, so that
fewer copies of queries travel; a block is multiplied in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.plans.lineage import cut

K = 10
SCALE = 1024
LISTS = 2
#: Entries each list gives up first, as a multiple of k.
HEAD = 4
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024
#: Beyond so many blocks these grow instead of their number, up to ``GROWTH`` times.
BLOCKS = 64
GROWTH = 4
#: Products held at a time.
TILE = ROWS_PER_BLOCK * QUERIES_PER_BLOCK

#: Sums below this are exact in doubles.
EXACT = 2**53


def quantised(vectors: DataFrame, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component. Rows without identifier, or with missing or non-finite components, go.

    Of rows with one identifier the smallest vector stays.
    """
    vector = vectors[vector_column].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x * scale).cast("long"))
    rows = vectors.where(vectors[id_column].isNotNull() & vector.isNotNull() & finite)
    return rows.select(vectors[id_column].cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two blocks of integer vectors, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def block_count(rows: int, per_block: int) -> int:
    """How many blocks ``rows`` make: of ``per_block`` rows, or of up to ``GROWTH`` times as many where there are many."""
    return max(1, math.ceil(rows / min(max(per_block, math.ceil(rows / BLOCKS)), per_block * GROWTH)))


class Search:
    """Blocks of rows and of queries, and the passes over them."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, lists: int, rows_per_block: int, queries_per_block: int, tile: int):
        size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.width, self.lists = size["width"] or 0, max(1, min(lists, size["width"] or 1))
        self.slice = max(1, math.ceil(self.width / self.lists))
        self.row_blocks = block_count(size["n"], rows_per_block)
        self.query_blocks = block_count(queries.count(), queries_per_block)
        self.rows = self.blocks(vectors, self.block_of(F.col("vec_id")))
        self.queries, self.tile = queries, tile

    def block_of(self, row: Column) -> Column:
        return F.pmod(F.xxhash64(row), F.lit(self.row_blocks)).cast("int")

    def query_block_of(self, query: Column) -> Column:
        return F.pmod(F.xxhash64(query, F.lit("query")), F.lit(self.query_blocks)).cast("int")

    def blocks(self, vectors: DataFrame, block: Column, *extra: str) -> DataFrame:
        """``block, list, ids, values`` and extra columns as arrays, in the order of ids; short vectors end in zeros."""
        padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.slice * self.lists) - F.size("v")))
        slices = F.posexplode(F.array(*[F.slice(padded, i * self.slice + 1, self.slice) for i in range(self.lists)])).alias("list", "part")
        row = F.struct("vec_id", "part", *extra)
        sliced = vectors.select(block.alias("block"), "vec_id", "v", *extra).select("block", "vec_id", *extra, slices)
        packed = sliced.groupBy("block", "list").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        columns = [F.col("rows.vec_id").alias("ids"), F.flatten("rows.part").alias("values")]
        return packed.select("block", "list", *columns, *[F.col(f"rows.{c}").alias(c) for c in extra])

    def met(self, extra: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
        """Each block of queries beside each block of rows, slice by slice; ``extra`` has a bigint for each query.

        ``asked``, with ``block, query_block, list`` and other columns, names the only ones to meet.
        """
        queries = self.queries if extra is None else self.queries.join(extra, F.col("vec_id") == F.col("query")).drop("query")
        columns = [] if extra is None else [c for c in extra.columns if c != "query"]
        packed = self.blocks(queries, self.query_block_of(F.col("vec_id")), *columns)
        packed = packed.withColumnsRenamed({"block": "query_block", "ids": "query_ids", "values": "query_values"})
        if asked is None:
            visiting = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.row_blocks - 1))))
        else:
            visiting = packed.join(asked, ["query_block", "list"])
        return self.rows.join(visiting, ["block", "list"])

    def run(self, met: DataFrame, emit: Callable, columns: list[str], kinds: str, tiled: bool = True) -> DataFrame:
        """``emit`` gets rows and queries as matrices, both id arrays and the extra arrays; it gives arrays of longs.

        With ``tiled`` the extra arrays have an entry for each query, and queries come a few at a time.
        """
        names, tile = [k.split()[0] for k in kinds.split(", ")], self.tile

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(batch.schema.get_field_index(name)).slice(i, 1) for name in ["list", "ids", "values", "query_ids", "query_values", *columns]}
                    ids, queries = (row[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "query_ids"))
                    own, theirs = matrix(row["values"], len(ids)), matrix(row["query_values"], len(queries))
                    extra = [row[c].flatten() for c in columns]
                    step = max(1, tile // max(1, len(ids))) if tiled else max(1, len(queries))
                    for at in range(0, len(queries), step):
                        some = slice(at, at + step)
                        found = emit(own, theirs[some], ids, queries[some], *([x[some] for x in extra] if tiled else extra))
                        number = np.full(len(found[0]), row["list"][0].as_py(), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, *found)], names=names)

        wanted = ["list", "ids", "values", "query_ids", "query_values", *columns]
        return met.select(*[F.col(c).cast("long") if c == "list" else F.col(c) for c in wanted]).mapInArrow(task, kinds)

    def heads(self, count: int) -> DataFrame:
        """Phase 1: the best ``count`` entries of every list: ``list, query, vec, local``."""

        def emit(own, theirs, ids, queries):
            local = products(own, theirs)
            hidden = ids[:, None] == queries[None, :]
            shown = np.where(hidden, np.iinfo(np.int64).min, local)
            some = min(count, len(ids))
            at = np.argpartition(-shown.astype(float), some - 1, axis=0)[:some]
            row, query = at.ravel(), np.tile(np.arange(len(queries)), some)
            kept = ~hidden[row, query]
            row, query = row[kept], query[kept]
            return queries[query], ids[row], local[row, query]

        entries = self.run(self.met(), emit, [], "list long, query long, vec long, local long")
        order = Window.partitionBy("list", "query").orderBy(F.desc("local"), "vec")
        return entries.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count).drop("nth")

    def reaching(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: all entries whose local score times the number of lists reaches the query's cutoff (NULL: all entries)."""
        lists = self.lists

        def emit(own, theirs, ids, queries, cutoff):
            local = products(own, theirs)
            wanted = cutoff.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            enough = local * lists >= wanted[None, :] if np.abs(local).max(initial=0) < EXACT else local >= -(-wanted // lists)[None, :]
            enough &= ids[:, None] != queries[None, :]
            row, query = np.nonzero(enough)
            return queries[query], ids[row], local[row, query]

        return self.run(self.met(cutoffs), emit, ["cutoff"], "list long, query long, vec long, local long")

    def looked_up(self, wanted: DataFrame) -> DataFrame:
        """Phase 3: local scores of entries ``list, query, vec``, in blocks as before."""
        pairs = F.collect_list(F.struct("query", "vec")).alias("pairs")
        asked = wanted.select("list", "query", "vec", self.block_of(F.col("vec")).alias("block"), self.query_block_of(F.col("query")).alias("query_block"))
        asked = asked.groupBy("block", "query_block", "list").agg(pairs).select("block", "query_block", "list", F.col("pairs.query").alias("asked_query"), F.col("pairs.vec").alias("asked_vec"))

        def emit(own, theirs, ids, queries, asked_query, asked_vec):
            query, vec = (a.to_numpy(zero_copy_only=False) for a in (asked_query, asked_vec))
            a, b = own[np.searchsorted(ids, vec)], theirs[np.searchsorted(queries, query)]
            return query, vec, np.einsum("ij,ij->i", a, b)

        return self.run(self.met(asked=asked), emit, ["asked_query", "asked_vec"], "list long, query long, vec long, local long", tiled=False)

    def totals(self, entries: DataFrame) -> DataFrame:
        """``query, vec, known, seen``: sum of the known local scores, and a bit for each list they are from."""
        bit = F.expr("shiftleft(1L, cast(list as int))")
        return entries.groupBy("query", "vec").agg(F.sum("local").alias("known"), F.sum(bit).alias("seen"))

    def missing(self, totals: DataFrame) -> DataFrame:
        number = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.lists - 1).cast("long"))).alias("list")
        each = totals.select("query", "vec", "seen", number)
        return each.where(F.expr("shiftright(seen, cast(list as int)) & 1") == 0).select("list", "query", "vec")

    def scored(self, totals: DataFrame) -> DataFrame:
        """``query, vec, score`` of rows of which some local scores may be missing."""
        found = self.looked_up(self.missing(totals)).select("query", "vec", "local")
        both = totals.select("query", "vec", F.col("known").alias("local")).unionAll(found)
        return both.groupBy("query", "vec").agg(F.sum("local").alias("score"))


def best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def kth(scores: DataFrame, k: int) -> DataFrame:
    """``query, cutoff``: the k-th best score, where there are so many."""
    return best(scores, k).where(F.col("rank") == k).select("query", F.col("score").alias("cutoff"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, head: int = HEAD,
    rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK,
    tile: int = TILE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest integer inner product, for each query, by the smaller
    ``vec_id`` where equal; all rows if there are fewer.

    Both tables have ``vec_id, v`` with distinct identifiers (see ``quantised``); a query does not find its own identifier.
    Vectors of different lengths are multiplied as if the shorter ended in zeros. Scores must fit a long.
    """
    search = Search(vectors, queries, lists, rows_per_block, queries_per_block, tile)
    every = queries.select(F.col("vec_id").alias("query"))
    first = cut(search.totals(search.heads(head * k)))
    cutoffs = cut(every.join(kth(search.scored(first), k), "query", "left"))
    entries = cut(search.totals(search.reaching(cutoffs)))
    full = (1 << search.lists) - 1
    raised = kth(entries.where(F.col("seen") == full).select("query", "vec", F.col("known").alias("score")), k).withColumnRenamed("cutoff", "raised")
    bounds = cut(cutoffs.join(raised, "query", "left").select("query", "cutoff", F.greatest("cutoff", "raised").alias("least")))
    # A local score that was not given up is below cutoff / lists.
    left = F.lit(search.lists) - F.bit_count("seen")
    known, cutoff, least = (F.col(c).cast("decimal(19,0)") for c in ("known", "cutoff", "least"))
    number = F.lit(search.lists).cast("decimal(9,0)")
    above = known * number + left.cast("decimal(9,0)") * cutoff
    open_ = entries.join(bounds, "query").where(F.col("least").isNull() | (above >= least * number))
    found = best(search.scored(cut(open_.select("query", "vec", "known", "seen"))), k)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")
