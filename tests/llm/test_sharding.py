"""Sharding: every row in one gapless slot, equal loads, groups together, and none of it changed by partitioning."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
from spectraloom.llm import sharding


def check_slots(rows, shards):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(0 <= s < shards and sorted(slots) == list(range(len(slots))) for s, slots in places.items())


def loads(rows, shards):
    filled = np.zeros((shards, 2))
    for r in rows:
        filled[r.shard] += (r.size, 1)
    return filled


def test_query_deals_every_row(spark, sf_dir):
    df = entry_module.queries()["op11_sharding"](spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    found = df.collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in found) == Counter(texts.keys())
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "bytes", None) for r in found)
    check_slots(found, 40)
    sizes = loads(found, 40)[:, 0]
    assert sizes.max() - sizes.min() <= max(r.size for r in found)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_loads_are_near_equal(spark, folder):
    filled = loads(entry_module.queries()["op11_sharding"](spark, folder).collect(), 40)
    assert np.ptp(filled[:, 0]) < 0.002 * filled[:, 0].mean()
    assert np.ptp(filled[:, 1]) < 0.3 * filled[:, 1].mean()


def straight(items, shards):
    """The rule stated one shard at a time."""
    total = [sum(i[d] for i in items) / shards or 1.0 for d in range(len(items[0]))]
    scaled = [[x / t for x, t in zip(i, total)] for i in items]
    left, found = [[1.0] * len(items[0]) for _ in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -max(scaled[i])):
        scores = [sum(a * b for a, b in zip(left[s], scaled[i])) for s in range(shards)]
        found[i] = max(range(shards), key=lambda s: (scores[s], -s))
        left[found[i]] = [a - b for a, b in zip(left[found[i]], scaled[i])]
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 64)] * 3), min_size=1, max_size=30), st.sampled_from([1, 2, 4, 8]))
def test_items_go_where_the_dot_product_is_highest(items, shards):
    found = sharding.place(np.array(items, float), shards)
    wanted = straight(items, shards)
    # Sums in another order may tell equal scores apart: then the loads agree all the same.
    if found.tolist() != wanted:
        assert sorted(np.bincount(found, minlength=shards)) == sorted(np.bincount(wanted, minlength=shards))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.integers(1, 9), st.integers(0, 10_000))
def test_settling_never_widens_the_gap(sizes, shards, seed):
    items = np.array([(s, 1, 1) for s in sizes], float)
    before = np.random.default_rng(seed).integers(0, shards, len(items))
    after = sharding.settle(items, before, shards)
    spreads = [np.ptp(np.bincount(x, items[:, 0], shards)) for x in (before, after)]
    assert spreads[1] <= spreads[0]
    assert spreads[1] <= max(sizes)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, shard int, key string, copies int")


def test_hot_groups_are_cut_and_others_stay_together(spark):
    """A third of the rows are copies under many identifiers, a fifth are copies of one row; small groups stay whole."""
    rows = [(i, "hot text " * 5) for i in range(600)] + [(9_999, "one row again and again")] * 400
    rows += [(10_000 + i, f"text {i % 300} " * 6) for i in range(900)]
    found = sharding.shard(frame(spark, rows).repartition(6), shards=8).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    check_slots(found, 8)
    filled = loads(found, 8)
    assert np.ptp(filled[:, 0]) < 0.03 * filled[:, 0].mean()
    shards = defaultdict(set)
    for r in found:
        shards[r.size, r.text_crc32].add(r.shard)
    texts = {t: (len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in rows}
    hot = {texts["hot text " * 5], texts["one row again and again"]}
    assert all(len(s) > 1 for k, s in shards.items() if k in hot)
    assert all(len(s) == 1 for k, s in shards.items() if k not in hot)


def test_partitioning_changes_nothing(spark, documents):
    one, other = (sharding.shard(documents.repartition(n, "lang"), shards=7).collect() for n in (1, 9))
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_odd_documents(spark, odd_documents):
    found = sharding.shard(odd_documents, shards=3).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_documents.collect())
    check_slots(found, 3)
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert (2, 16, 0) in sizes and (3, 16, 0) in sizes
    pair = [r.shard for r in found if r.doc_id in (2, 3)]
    assert len(found) == odd_documents.count() and len(set(pair)) <= 2


def test_empty_table(spark, odd_documents):
    found = sharding.shard(odd_documents.limit(0))
    assert found.collect() == [] and found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_fewer_rows_than_shards(spark):
    found = sharding.shard(frame(spark, [(1, "a"), (2, "b")]), shards=40).collect()
    check_slots(found, 40)
    assert len({r.shard for r in found}) == 2
