import math
import random

import pytest

from spectraloom.llm import topk
from spectraloom.llm.queries import op4_topk


def brute(rows, queries, k=10):
    found = []
    for q, a in sorted(queries.items()):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows.items() if v != q)
        found += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return found


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r.vec_id: [math.floor(1024 * x) for x in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    wanted = brute(rows, {v: a for v, a in rows.items() if v % 100 == 0})
    assert sorted(map(tuple, op4_topk(spark, sf_dir).collect())) == wanted


@pytest.mark.parametrize("options", [dict(k=3), dict(k=3, lists=3, head=1, rows_per_block=7, queries_per_block=2), dict(k=50, lists=1), dict(k=4, tile=90)])
def test_ties_and_signs(spark, options):
    """Few different values: many equal scores, many negative ones."""
    choice = random.Random(4)
    rows = {i: [choice.randint(-2, 2) for _ in range(choice.choice([5, 5, 5, 3]))] for i in range(40)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, v array<long>")
    queries = {i: rows[i] for i in range(0, 40, 5)}
    found = topk.top_k(df, df.where("vec_id % 5 = 0"), **options).collect()
    assert sorted(map(tuple, found)) == brute(rows, queries, options["k"])


def test_large_components(spark):
    """Products beyond what doubles hold."""
    rows = {i: [10**9 + i, -(10**9) + 3 * i] for i in range(6)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, v array<long>")
    assert sorted(map(tuple, topk.top_k(df, df, k=3).collect())) == brute(rows, rows, 3)


def test_blocks_grow_with_large_tables():
    per_block = topk.ROWS_PER_BLOCK
    assert [topk.block_count(n, per_block) for n in (0, 1, per_block, per_block + 1)] == [1, 1, 1, 2]
    most = topk.BLOCKS * per_block
    assert topk.block_count(most, per_block) == topk.block_count(2 * most, per_block) == topk.block_count(topk.GROWTH * most, per_block) == topk.BLOCKS
    assert topk.block_count(100 * most, per_block) == 100 * topk.BLOCKS // topk.GROWTH


def test_bounds_are_whole_numbers(spark):
    """Totals beyond 2**53 that differ by one: a bound rounded up would lose the better row."""
    big = 2**30
    rows = {0: [big, big], 1: [big, big], 2: [big, big - 1], 3: [big + 1, big], 4: [big, big + 2], 5: [1, big * 2]}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, v array<long>")
    for k in (1, 2, 3):
        found = topk.top_k(df, df.where("vec_id < 3"), k=k, head=1, rows_per_block=2).collect()
        assert sorted(map(tuple, found)) == brute(rows, {q: rows[q] for q in range(3)}, k)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25], "a"), (2, None, "b"), (3, [nan, 1.0], "c"), (4, [inf, 1.0], "d"), (5, [None, 1.0], "e"), (None, [1.0, 1.0], "f"),
            (6, [0.5, -0.25], "g"), (6, [0.5, -0.25], "g"), (7, [], "h"), (0, [1.0, 0.0009], None)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"))
    assert {r.vec_id: list(r.v) for r in df.collect()} == {1: [512, -256], 6: [512, -256], 7: [], 0: [1024, 0]}
    found = topk.top_k(df, df.where("vec_id = 0"), k=2).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 512 * 1024), (0, 2, 6, 512 * 1024)]
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []
