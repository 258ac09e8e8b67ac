import hashlib
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.operators import sampling
from spectraloom.operators.sampling import group_choices, sample, target_size


@pytest.fixture(scope="module")
def table(spark):
    group = F.expr("CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 50 = 1 THEN NULL ELSE concat('g', id % 7) END")
    return spark.range(3000).withColumn("group_c", group).cache()


def ids(df):
    return {r.id for r in df.select("id").collect()}


def by_hash(keys):
    return sorted(keys, key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())


def test_target_size():
    assert target_size(1000, n=10, pct=25) == 250
    assert target_size(1000, n=10) == 10
    assert target_size(10, pct=1) == 1
    assert target_size(999, pct=50) == 499
    assert target_size(1000) == 1000


def test_group_choices():
    assert group_choices(["country_code", "latitude_dd", "landuse_txt"]) == ["country_code", "landuse_txt"]


@pytest.mark.parametrize("n", [1, 2, 100, 1500, 2999])
def test_exact_size(table, n):
    assert ids(sample(table, n=n, identity=["id"])) == set(by_hash(range(3000))[:n])


def test_nothing_to_do(table):
    assert sample(table) is table
    assert sample(table, n=3000) is table
    assert sample(table, n=9000, by="group_c") is table
    assert sample(table.limit(0), n=5).count() == 0


def test_same_rows_under_any_partitioning(table):
    wanted = ids(sample(table, pct=7, identity=["id"]))
    for parts in (1, 3, 7):
        assert ids(sample(table.repartition(parts), pct=7, identity=["id"])) == wanted


def stratified_wanted(table, target):
    groups = {}
    for row in table.collect():
        groups.setdefault(row.group_c, []).append(row.id)
    total = sum(map(len, groups.values()))
    groups.pop(None)
    return {k for keys in groups.values() for k in by_hash(keys)[: max(1, round(target * len(keys) / total))]}


@pytest.mark.parametrize("target", [3, 100, 1234])
def test_stratified(table, target):
    assert ids(sample(table, n=target, by="group_c", identity=["id"])) == stratified_wanted(table, target)


def test_stratified_by_many_groups(table, monkeypatch):
    """Beyond the broadcast limit the bounds are checkpointed and joined, with a hot group split."""
    monkeypatch.setattr(sampling, "BROADCAST_GROUPS", 2)
    monkeypatch.setattr(sampling, "HOT_SHARE", 0.2)
    monkeypatch.setattr(sampling, "HOT_ROWS", 100)
    assert ids(sample(table, n=500, by="group_c", identity=["id"])) == stratified_wanted(table, 500)


def test_many_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BROADCAST_GROUPS", 1)
    df = spark.range(900).selectExpr("id % 3 AS group_id", "id % 9 AS v")
    found = {r.group_id: r["count"] for r in sample(df, n=300, by="group_id").groupBy("group_id").count().collect()}
    assert found == {0: 100, 1: 100, 2: 100}


def test_composes(table):
    half = sample(table, pct=50, identity=["id"])
    quarter = sample(half, pct=50, identity=["id"])
    assert ids(quarter) <= ids(half) and len(ids(quarter)) == 750


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(copies=st.lists(st.integers(1, 60), min_size=1, max_size=6), share=st.floats(1, 99))
def test_copies_are_drawn_exactly(spark, copies, share):
    """Rows that are copies of each other: the size is exact and no row appears more often than it did."""
    rows = [(i, f"v{i % 2}") for i, n in enumerate(copies) for _ in range(n)]
    df = spark.createDataFrame(rows, "a int, b string")
    found = sample(df, pct=share).groupBy("a").count().collect()
    assert sum(r["count"] for r in found) == max(1, int(len(rows) * share / 100))
    assert all(r["count"] <= copies[r.a] for r in found)


def test_many_copies_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK", 100)
    found = sample(spark.range(5000).select(F.lit("x").alias("a")), n=1700)
    assert found.count() == 1700


def test_rows_that_differ_only_in_nested_columns(spark):
    """One identity for all rows: the content decides, and every row counts once."""
    df = spark.range(400).selectExpr("1 AS a", "array(id) AS spectrum")
    found = [r.spectrum[0] for r in sample(df, n=123).collect()]
    assert len(found) == len(set(found)) == 123


def test_plain_sample_is_one_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    plan = sample(df, n=20, identity=["c_custkey"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_shares_are_exact_whole_numbers(spark):
    """Products beyond 64 bits, and halves rounded to the even number."""
    target, total = 4_000_000_000, 10_000_000_001
    sizes = [5_000_000_000, 5_000_000_001, 1]
    found = spark.createDataFrame([(s,) for s in sizes], "size long").select(sampling._share(target, total).alias("q")).collect()
    assert [r.q for r in found] == [max(1, round(Fraction(target * s, total))) for s in sizes]
    halves = spark.createDataFrame([(1,), (3,), (5,), (7,)], "size long").select(sampling._share(1, 2).alias("q")).collect()
    assert [r.q for r in halves] == [1, 2, 2, 4]


def test_nan_is_no_group(spark):
    rows = [(i, float("nan") if i % 3 == 0 else float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g double")
    assert {r.g for r in sample(df, pct=20, by="g").collect()} == {1.0, 2.0}


@pytest.mark.parametrize("by", [None, "group_c"])
@pytest.mark.parametrize("many", [False, True])
def test_few_hashes_are_ranked(table, monkeypatch, by, many):
    """Prefixes are refined until few hashes are left; the sample is the same."""
    wanted = ids(sample(table, n=321, by=by, identity=["id"]))
    monkeypatch.setattr(sampling, "PREFIX", 1)
    monkeypatch.setattr(sampling, "RANKED", 3)
    if many:
        monkeypatch.setattr(sampling, "BROADCAST_GROUPS", 1)
    assert ids(sample(table, n=321, by=by, identity=["id"])) == wanted
