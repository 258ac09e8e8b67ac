"""Helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.plans.lineage import shared_folder

#: What a Python task gets at a time: a bounded number of bytes, whatever the length of the texts.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def small_batches(spark: SparkSession) -> SparkSession:
    """Set the session's Arrow batches to a size that leaves Python workers room."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % divisor


def fresh(df: DataFrame, stem: str) -> str:
    """A column name ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(name for i in range(len(taken) + 1) if (name := f"{stem}_{i}") not in taken)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, as a table that is read from there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: lambdas that mention a computed column would compute it per element."""
    return F.transform(F.array(value), use)[0]


def running_totals(numbers: Column, block: int = 64, combine=lambda x, y: x + y) -> Column:
    """For an array of long: the sum of the elements before each one, or what else ``combine`` makes of them and zero.

    Blocks are summed first, so n elements cost about n * block steps instead of n * n.
    """
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, combine)

    def blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: total(F.slice(a, b * block + 1, block)))

    def before(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, 1, b)))

    def each(a: Column, offsets: Column) -> Column:
        return F.transform(a, lambda _, i: combine(F.get(offsets, F.floor(i / block).cast("int")), total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block))))

    return bind(numbers, lambda a: bind(blocks(a), lambda sums: bind(before(sums), lambda offsets: each(a, offsets))))


SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string,scope:bigint>"


def spans(text: Column, pattern: str, context: int = 0, hint: Column | None = None, scopes: bool = False) -> Column:
    """Matches of a pattern that never matches nothing: leftmost, not overlapping, in code points, end exclusive.

    Each has up to ``context`` characters of its surroundings on either side, whatever these hold (matches must have two
    characters at least then), and, with ``scopes``, the number of blank lines before it (no match may hold a line break
    then). Rows where ``hint`` is false have no matches.
    """
    regex, nothing, zero = F.lit(pattern), F.array().cast(f"array<{SPAN}>"), F.lit(0).cast("long")

    empty = F.array().cast("array<string>")

    def struct(gaps: Column, begins: Column, blanks: Column | None, value: Column, i: Column, sides: Column | None) -> Column:
        gap = F.get(gaps, i)
        start = F.get(begins, i) + F.char_length(gap)
        before = after = F.lit("")
        if sides is not None:
            # A neighbouring match and the gap beyond it have two characters at least: half as many of them reach far enough.
            reach = context // 2 + 1
            earlier = F.slice(sides["left"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
            later = F.slice(sides["right"], i + 2, F.lit(reach))
            before = F.right(F.concat(F.array_join(earlier, ""), F.right(gap, F.lit(context))), F.lit(context))
            after = F.left(F.concat(F.left(F.get(gaps, i + 1), F.lit(context)), F.array_join(later, "")), F.lit(context))
        scope = zero if blanks is None else F.get(blanks, i) + blank_lines(gap)
        end = start + F.char_length(value)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"), after.alias("after"), scope.alias("scope"))

    def around(values: Column, gaps: Column) -> Column:
        """The ends of what lies before and after each gap: a match and the gap on its other side."""
        left = F.transform(values, lambda v, i: F.right(F.concat(F.get(gaps, i), v), F.lit(context)))
        right = F.transform(values, lambda v, i: F.left(F.concat(v, F.get(gaps, i + 1)), F.lit(context)))
        return F.struct(F.coalesce(left, empty).alias("left"), F.coalesce(right, empty).alias("right"))

    def placed(values: Column, gaps: Column) -> Column:
        own = F.slice(gaps, 1, F.size(values))
        begins = running_totals(F.zip_with(own, values, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long")))
        if not scopes:
            if context:
                return bind(begins, lambda at: bind(around(values, gaps), lambda sides: F.transform(values, lambda v, i: struct(gaps, at, None, v, i, sides))))
            return bind(begins, lambda at: F.transform(values, lambda v, i: struct(gaps, at, None, v, i, None)))
        blanks = running_totals(F.transform(own, blank_lines))
        return bind(begins, lambda at: bind(blanks, lambda no: F.transform(values, lambda v, i: struct(gaps, at, no, v, i, None))))

    def of(values: Column) -> Column:
        return F.when(F.size(values) == 0, nothing).otherwise(bind(F.split(text, pattern, -1), lambda gaps: placed(values, gaps)))

    found = bind(F.regexp_extract_all(text, regex, F.lit(0)), of)
    return found if hint is None else F.when(hint, found).otherwise(nothing)


def blank_lines(gap: Column) -> Column:
    return (F.size(F.split(gap, "\n(?=[ \t\r]*\n)", -1)) - 1).cast("long")


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
