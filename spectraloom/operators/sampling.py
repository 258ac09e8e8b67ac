"""Exact-size random and stratified samples.

Rows are put in a random but fixed order by an MD5 hash of their identity, and each group takes its first rows in that
order. No group is ever sorted as a whole: counting rows per hash prefix and group, combined map-side, tells where a
group's quota ends, and the sample is then a plain filter ``hash < bound`` on one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.names import col, column_family
from spectraloom.plans.lineage import cut

# Fixed value: the seed of every sample.
SEED = 42

# Hash digits by which rows are counted at a time: at most 65 536 counters per group.
PREFIX = 4
HASH_DIGITS = 32
# Hashes of one group that are ranked; a quota that ends among more is first looked for by further digits.
RANKED = 100_000
# Sorts after every hexadecimal digit, so ``prefix + PAST`` bounds all hashes that start with ``prefix``.
PAST = "g"
# Up to this many groups the bounds are held on the driver and broadcast; beyond, they are joined.
BROADCAST_GROUPS = 10_000
# Which of many groups are broadcast all the same: at most a hundred, by the share.
HOT_SHARE = 0.01
HOT_ROWS = 100_000
# Copies of one row written out per task.
COPIES_PER_TASK = 1_000_000


def identity_columns(df: DataFrame) -> list[str]:
    """Default identity of a row: every column that is not nested."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def row_hash(identity: Sequence[str], seed: int = SEED) -> Column:
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in identity]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))).cast("binary"))


def group_choices(site_columns: Sequence[str]) -> list[str]:
    """Columns offered for stratification: the categorical ones."""
    return [c for c in site_columns if column_family(c) == "levels"]


def target_size(rows: int, n: int = 0, pct: float = 0) -> int:
    """A percentage wins over a number; neither keeps everything."""
    if pct and pct > 0:
        return max(1, int(rows * pct / 100))
    if n and n > 0:
        return int(n)
    return rows


def _running(counts: DataFrame, key: str) -> DataFrame:
    so_far = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("n").over(so_far)
    return counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("n"))


def _cut(counts: DataFrame, key: str, quota: str) -> DataFrame:
    """Per group: the last ``key`` that fits the quota whole, the one that does not, how many that one gives and has."""
    straddles = (F.col("_before") < F.col(quota)) & (F.col("_upto") > F.col(quota))
    return _running(counts, key).groupBy("_g").agg(
        F.max(F.when(F.col("_upto") <= F.col(quota), F.col(key))).alias("full"),
        F.max(F.when(straddles, F.col(key))).alias("edge"),
        F.max(F.when(straddles, F.col(quota) - F.col("_before"))).alias("rest"),
        F.max(F.when(straddles, F.col("n"))).alias("size"),
    )


class PerGroup:
    """A table with one row per group ``_g``: held on the driver for few groups, checkpointed for many.

    Either way it is fixed, so that later reads agree and do not compute it again. ``hot`` lists the large ones of many
    groups, of which there are few.
    """

    def __init__(self, df: DataFrame, rows: pa.Table | None, hot: Sequence[object] = ()):
        self.df, self.rows, self.hot = df, rows, hot

    @staticmethod
    def held(spark: SparkSession, rows: pa.Table) -> PerGroup:
        return PerGroup(spark.createDataFrame(rows), rows)

    def like(self, df: DataFrame) -> PerGroup:
        """Another table on the same groups, or some of them."""
        few = self.rows is not None
        return PerGroup.held(df.sparkSession, df.toArrow()) if few else PerGroup(cut(df), None, self.hot)

    def having(self, column: str) -> PerGroup:
        """The groups in which ``column`` is not NULL."""
        if self.rows is not None:
            return PerGroup.held(self.df.sparkSession, self.rows.filter(self.rows[column].is_valid()))
        return PerGroup(self.df.where(F.col(column).isNotNull()), None, self.hot)

    def is_empty(self) -> bool:
        return self.df.isEmpty() if self.rows is None else self.rows.num_rows == 0

    def attach(self, df: DataFrame, *columns: str) -> DataFrame:
        """Add columns of the row's group; rows of other groups drop out.

        Few groups are broadcast, and so are the hot ones of many, while the others are joined by a shuffle.
        """
        per_group = self.df.select("_g", *columns)
        if self.rows is not None and self.rows.num_rows == 1:
            row = self.rows.to_pylist()[0]
            return df.where(F.col("_g") == F.lit(row["_g"])).withColumns({c: F.lit(row[c]) for c in columns})
        if self.rows is not None:
            return df.join(F.broadcast(per_group), "_g")
        if not self.hot:
            return df.join(per_group, "_g")
        is_hot = F.col("_g").isin(list(self.hot))
        hot_rows = df.where(is_hot).join(F.broadcast(per_group.where(is_hot)), "_g")
        return hot_rows.unionByName(df.where(~is_hot).join(per_group.where(~is_hot), "_g"))


def _quotas(df: DataFrame, group: Column, n: int, pct: float) -> PerGroup | None:
    """How many rows each group gives; None when the sample is the whole table."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    rows = sizes.limit(BROADCAST_GROUPS + 1).toArrow()
    few = rows.num_rows <= BROADCAST_GROUPS
    sizes = sizes if few else cut(sizes)
    total = (pc.sum(rows["size"]).as_py() if few else sizes.agg(F.sum("size")).first()[0]) or 0
    target = target_size(total, n, pct)
    if target >= total:
        return None
    known = sizes.where(F.col("_g").isNotNull())
    if isinstance(sizes.schema["_g"].dataType, (T.DoubleType, T.FloatType)):
        known = known.where(~F.isnan("_g"))
    quotas = known.select("_g", _share(target, total).alias("quota"))
    if few:
        return PerGroup.held(df.sparkSession, quotas.toArrow())
    hot = known.where(F.col("size") >= max(HOT_ROWS, HOT_SHARE * total)).select("_g").collect()
    return PerGroup(quotas, None, [row[0] for row in hot])


def _share(target: int, total: int) -> Column:
    """``target * size / total`` in whole numbers, halves to even, at least 1."""
    product = f"(cast(size as decimal(19, 0)) * cast({target} as decimal(19, 0)))"
    whole = f"({product} div cast({total} as decimal(19, 0)))"
    twice = f"(2 * ({product} - {whole} * cast({total} as decimal(19, 0))))"
    up = f"({twice} > {total} or {twice} = {total} and {whole} % 2 = 1)"
    return F.expr(f"greatest(1L, cast({whole} as bigint) + if({up}, 1L, 0L))")


def _bounds(keyed: DataFrame, quotas: PerGroup, first: DataFrame | None = None) -> DataFrame:
    """``(_g, bound, tie, quota)``: take hashes below ``bound``, and ``quota`` of the rows hashed to ``tie``.

    Digit by digit, ``PREFIX`` at a time, only the prefix in which a quota ends is looked at closer, until few enough
    hashes are left there to rank them. ``first`` has the counts ``(_g, p, n)`` by the first digits, where they are known.
    """
    state, depth = quotas.like(quotas.df.selectExpr("_g", "quota AS rest", "'' AS edge", "CAST(NULL AS STRING) AS full")), PREFIX
    while True:
        open_ = state.having("edge")
        if open_.is_empty() or depth > HASH_DIGITS:
            break
        if first is not None and depth == PREFIX:
            counts = open_.attach(first, "rest")
        else:
            # Copies of a row collapse before they are ranked.
            inside = open_.attach(keyed, "edge", "rest").where(F.col("_h").startswith(F.col("edge")))
            counts = inside.groupBy("_g", "rest", F.substring("_h", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        found = _cut(counts, "p", "rest").toDF("_g", "found", "next", "left", "size")
        # Where a level is looked at, it says all about the edge; elsewhere the state stays.
        merged = state.df.select("_g", "rest", "edge", "full").join(found.withColumn("seen", F.lit(True)), "_g", "left")
        last = F.coalesce("found", "full").alias("full")
        state = state.like(merged.select("_g", F.when(F.col("seen"), F.col("left")).otherwise(F.col("rest")).alias("rest"),
                                         F.when(F.col("seen"), F.col("next")).otherwise(F.col("edge")).alias("edge"), last, "size"))
        if depth == HASH_DIGITS:
            break
        largest = state.df.agg(F.max("size")).first()[0] or 0
        depth = HASH_DIGITS if largest <= RANKED else depth + PREFIX
    return state.df.select("_g", _past(F.col("full")).alias("bound"), F.col("edge").alias("tie"), F.col("rest").alias("quota"))


def _past(last: Column | str) -> Column:
    """What sorts after all hashes that start with ``last``, and before all others; nothing is below a NULL's."""
    return F.coalesce(F.concat(last, F.lit(PAST)), F.lit(""))


def _copies(ties: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``quota`` rows of each group, whose rows are copies of each other: they are counted and written out again in
    pieces, so that a large group of copies is no single task."""
    counted = ties.groupBy("_g", "quota", *map(col, columns)).agg(F.count(F.lit(1)).alias("n"))
    content = F.xxhash64(*map(col, columns))
    taken = F.least(F.col("n"), F.col("quota") - F.col("_before"))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / COPIES_PER_TASK))
    size = F.least(F.lit(COPIES_PER_TASK).cast("long"), F.col("_taken") - F.col("_piece") * COPIES_PER_TASK)
    return (
        _running(counted.withColumn("_content", content), "_content")
        .withColumn("_taken", taken)
        .where(F.col("_taken") > 0)
        .withColumn("_piece", F.explode(pieces))
        .repartition("_g", "_piece")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size)))
        .select(*map(col, columns))
    )


def _take(df: DataFrame, columns: Sequence[str], quotas: PerGroup, hashes: Sequence[Column], first: DataFrame | None = None) -> DataFrame:
    """``quota`` rows of each group ``_g`` by hash order; later hashes settle ties of earlier ones."""
    if not hashes:
        return _copies(quotas.attach(df, "quota"), columns)
    keyed = df.withColumn("_h", hashes[0])
    bounds = quotas.like(_bounds(keyed.select("_g", "_h"), quotas, first))
    taken = bounds.attach(keyed, "bound").where(F.col("_h") < F.col("bound")).select(*map(col, columns))
    ties = bounds.having("tie")
    if ties.is_empty():
        return taken
    tied = ties.attach(keyed, "tie").where(F.col("_h") == F.col("tie")).drop("_h", "tie")
    return taken.unionByName(_take(tied, columns, ties, hashes[1:]))


def sample(
    df: DataFrame,
    n: int = 0,
    pct: float = 0,
    by: str | None = None,
    identity: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``n`` rows, or ``pct`` percent of them; with ``by`` in proportion to the groups, at least one row of each.

    ``identity`` names the columns that identify a row (default: all that are not nested); the same rows are drawn
    however the data is partitioned. With ``by`` a group's share is rounded, so the total may differ from ``n``, and
    rows without a group (NULL or NaN) are left out. Narrow jobs over identity and group find where each quota ends, two
    for most tables; the sample itself is lazy. When the input is expensive to compute, pass it through ``plans.lineage.cut`` first.
    """
    identity = list(identity or identity_columns(df))
    group = (F.lit(0) if by is None else col(by)).alias("_g")
    hashes, first = [row_hash(identity, seed)], None
    if by is None:
        # At most 65 536 counts; they tell the total as well.
        prefixes = df.groupBy(F.lit(0).alias("_g"), F.substring(hashes[0], 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        total = pc.sum(prefixes["n"]).as_py() or 0
        first = df.sparkSession.createDataFrame(prefixes) if total else None
        target = target_size(total, n, pct)
        whole = pa.table({"_g": pa.array([0], pa.int32()), "quota": pa.array([target], pa.int64())})
        quotas = PerGroup.held(df.sparkSession, whole) if target < total else None
    else:
        quotas = _quotas(df, group, n, pct)
    if quotas is None:
        return df
    if set(identity) != set(df.columns):
        content = F.lower(F.lpad(F.hex(F.xxhash64(*map(col, df.columns))), 16, "0"))
        hashes.append(F.rpad(content, HASH_DIGITS, "0"))
    return _take(df.withColumn("_g", group), df.columns, quotas, hashes, first)
