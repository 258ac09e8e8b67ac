"""Equi-joins of several tables on one key that may hold a large share of the rows.

Without hot keys these are Spark's own joins: broadcast when a side is small, else sort-merge with AQE. For hot keys AQE
is not enough: it cannot split either side of a full join, nor the right side of a left join. Their rows are therefore
spread over a grid of cells with one axis per table. A row picks one cell on its own table's axis if its key is hot
there, and is copied along every other axis on which its key is hot, so rows that belong together meet in exactly one
cell. Rows of other keys stay single, in cell 0.

All joins of the tables use the same columns, key and cell number, so that a table, or the result of a first join, is shuffled
once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.names import col

# The column that numbers a row's cell, and joins on beside the key.
CELL = "_cell"
# How many rows a row stands for; with the table's name behind it while tables are joined.
STANDS = "_stands"


@dataclass(frozen=True)
class SkewPolicy:
    """A key is hot when it holds more than ``partitions`` times the rows of an even shuffle partition, and ``min_rows``.

    What counts is the partition a key makes, so the bound follows from the table's size and the number of partitions.
    """

    partitions: float = 3.0
    min_rows: int = 100_000


@dataclass(frozen=True)
class HotKeys:
    """Hot keys of each table with their share of its rows, those of them that occur in all tables, and for each table the
    hashes of rows that occur often among those of its hot keys."""

    by_table: Mapping[str, Mapping[object, float]]
    matched: tuple = ()
    repeated: Mapping[str, tuple[int, ...]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return any(self.by_table.values())


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(tables: Mapping[str, DataFrame], key: str, policy: SkewPolicy = SkewPolicy()) -> dict[str, dict]:
    """Hot keys of each table, NULL among them, with their share of its rows.

    One job that scans the key columns, with a sketch per task whose size follows from the number of partitions: it tracks
    ten times as many keys as can be hot, and cannot miss one. Nothing depends on the sketch being exact: any set of keys
    gives the same join result.
    """
    hot: dict[str, dict] = {name: {} for name in tables}
    keys = [df.select(F.lit(name).alias("t"), col(key).alias("k")) for name, df in tables.items() if not df.isStreaming]
    if not keys:
        return hot
    share = policy.partitions / max(shuffle_partitions(next(iter(tables.values()))), 1)
    candidates = min(100_000, math.ceil(1 / min(share, 1.0)) + 1)
    sketch = F.expr(f"approx_top_k(k, {candidates}, {10 * candidates})")
    every = reduce(DataFrame.unionAll, keys)
    for found in every.groupBy("t").agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).collect():
        least = max(policy.min_rows, share * found.n)
        hot[found.t] = {t["item"]: t["count"] / found.n for t in found.top if t["count"] >= least}
    return hot


def present_keys(tables: Sequence[DataFrame], key: str, wanted: Sequence[object]) -> list:
    """Which of a short list of keys occur in all tables."""
    wanted = [k for k in wanted if k is not None]
    if not wanted:
        return []
    found = [df.where(col(key).isin(wanted)).select(F.lit(i).alias("t"), col(key).alias("k")) for i, df in enumerate(tables)]
    seen = {(row.k, row.t) for row in reduce(DataFrame.unionAll, found).distinct().collect()}
    return [k for k in wanted if all((k, i) in seen for i in range(len(tables)))]


def content(df: DataFrame) -> Column:
    return F.xxhash64(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def add_salt(df: DataFrame, name: str, salts: int) -> DataFrame:
    """A row's cell number, by a hash of its content, so that a row has the same one whenever it is computed again.

    Exact copies of a row share a cell; those that occur often are counted before, see ``spread``.
    """
    return df.withColumn(name, F.pmod(content(df), F.lit(salts)).cast("int"))


def frequent_copies(tables: Mapping[str, DataFrame], key: str, hot: Mapping[str, Iterable], policy: SkewPolicy = SkewPolicy()) -> dict[str, tuple[int, ...]]:
    """For each table the hashes of rows that hold as large a share of its hot keys' rows as makes a key hot.

    Tables whose rows cannot be grouped (they hold maps) have none. One job, with the sketches of ``frequent_keys``; as there,
    any set of hashes gives the same join result.
    """
    grouped = {name: df for name, df in tables.items() if hot.get(name) and not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields)}
    rows = {name: df.where(among(key, hot[name]) | col(key).isNull()).select(content(df).alias("h")) for name, df in grouped.items()}
    return {name: tuple(found) for name, found in frequent_keys(rows, "h", policy).items() if found}


def salt_count(df: DataFrame, hot: Mapping[str, Mapping[object, float]]) -> int:
    """Cells per axis, so that a cell holds about as many rows as an ordinary shuffle partition."""
    partitions = shuffle_partitions(df)
    cells = 2
    for key in {k for keys in hot.values() for k in keys}:
        shares = [keys[key] for keys in hot.values() if key in keys]
        cells = max(cells, math.ceil((max(shares) * partitions) ** (1 / len(shares))))
    return cells


def among(key: str, keys: Iterable[object]) -> Column:
    keys = [k for k in keys if k is not None]
    return F.coalesce(col(key).isin(keys), F.lit(False)) if keys else F.lit(False)


def counted_copies(df: DataFrame, salts: int) -> DataFrame:
    """One row for each of ``salts`` shares of a row's copies: its cell on the own axis and how many copies it stands for."""
    counted = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    shares = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = F.floor(col("_n") / salts) + (col("_salt") < col("_n") % salts).cast("long")
    return shares.withColumn(STANDS, held).where(col(STANDS) > 0).drop("_n")


def spread(
    df: DataFrame, own: str, key: str, hot: Mapping[str, Iterable], copied: Mapping[str, Iterable], salts: int, repeated: Mapping[str, Iterable[int]] = {}
) -> DataFrame:
    """Add the cell's number to the rows of one table.

    ``hot`` names the hot keys of every table, ``copied`` those along whose axis this table's rows are to be copied.
    Rows without a key have no partner and are spread without copies. Rows whose hash is among the table's ``repeated`` ones
    are counted and dealt out evenly; they stand for several rows until ``written_out``.
    """
    axes = [name for name, keys in hot.items() if keys]
    if own in axes:
        here, step = among(key, hot[own]) | col(key).isNull(), salts ** axes.index(own)
        often = [int(h) for h in repeated.get(own, ())]
        several = here & content(df).isin(often) if often else F.lit(False)
        single = add_salt(df.where(~several) if often else df, "_salt", salts).withColumn("_salt", F.when(here, col("_salt")).otherwise(0))
        if often:
            single = single.withColumn(STANDS, F.lit(1).cast("long")).unionByName(counted_copies(df.where(several), salts))
            single = single.withColumnRenamed(STANDS, f"{STANDS}_{own}")
        df = single.withColumn(CELL, (col("_salt") * step).cast("long")).drop("_salt")
    else:
        df = df.withColumn(CELL, F.lit(0).cast("long"))
    for i, axis in enumerate(axes):
        keys = [k for k in copied.get(axis, ()) if k is not None]
        if axis != own and keys:
            step = salts**i
            every = F.sequence(F.lit(0), F.lit((salts - 1) * step), F.lit(step))
            copies = F.explode_outer(F.when(among(key, keys), every).otherwise(F.array(F.lit(0))))
            df = df.withColumn("_copy", copies).withColumn(CELL, col(CELL) + col("_copy")).drop("_copy")
    return df


def written_out(joined: DataFrame) -> DataFrame:
    """Rows that stand for several, as so many rows."""
    counts = [c for c in joined.columns if c.startswith(f"{STANDS}_")]
    if not counts:
        return joined
    times = reduce(Column.__mul__, [F.coalesce(col(c), F.lit(1).cast("long")) for c in counts])
    one = F.lit(1).cast("long")
    # One at a time is the rule: no array is built for it.
    return joined.withColumn(STANDS, F.explode(F.when(times == 1, F.array(one)).otherwise(F.sequence(one, times)))).drop(STANDS, *counts)


def drop_unpaired(joined: DataFrame, key: str, matched: Iterable[object], left_mark: str, right_mark: str) -> DataFrame:
    """After an outer join: a key that occurs on both sides has partners for all its rows, so an unpaired copy of one is
    an empty cell and not a result."""
    paired = col(left_mark).isNotNull() & col(right_mark).isNotNull()
    return joined.where(~among(key, matched) | paired)
