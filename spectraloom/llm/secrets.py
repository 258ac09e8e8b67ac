"""Secrets in texts, with credentials linked from their parts, in column expressions only.

Three base kinds are reported wherever they occur. Weak candidates - a bare key, a user or client identifier, an endpoint -
mean little alone. They are reported when the parts that complete them stand nearby: parts of a text are joined by
intervals, within ``REACH`` characters and within one scope, a stretch of text without a blank line.

Only texts with weak candidates and other parts take part in that join, each text once however many copies it has. A part
looks for the nearest part of each class before and after it in order of position, so no pairs are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import bind, fresh, running_totals, spans, stored, written

REACH = 400
#: Links are broadcast up to so many bytes; a span, or a key, takes less than SPAN_BYTES.
SMALL, SPAN_BYTES = 8 << 20, 128
MASK = "[SECRET]"

_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?"
# The patterns of the base kinds are given.
BASE = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
WEAK = {
    "bare_key": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "identifier": rf"(?i)\b(?:client_?id|user_?name|user|login|account){_VALUE}[A-Za-z0-9@._-]{{3,}}",
    "endpoint": r"(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?",
}
KINDS = (*BASE, *WEAK)
#: What part of a credential each kind is.
CLASS = {"assign": "secret", "hex": "secret", "bare_key": "secret", "access": "identity", "identifier": "identity", "endpoint": "endpoint"}
#: Classes a weak kind needs nearby.
NEEDS = {"bare_key": ("identity",), "identifier": ("secret", "endpoint"), "endpoint": ("identity", "secret")}
#: Texts without a match have none of the kind.
HINTS = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}", "bare_key": "[A-Za-z0-9+/]{40}", "identifier": "[:=]", "endpoint": "://"}


def valid(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(value, BASE["assign"], 1)) >= 8
    if kind == "access":
        return F.length(value) >= 16
    if kind == "bare_key":
        return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return F.lit(True)


def detected(text: Column, kind: str, scopes: bool = False) -> Column:
    """Valid spans of one kind: ``start, nth, kind, end, scope``, so that sorting goes by start, then kind as listed."""
    found = spans(text, {**BASE, **WEAK}[kind], 0, text.rlike(HINTS[kind]), scopes)
    kept = F.filter(found, lambda s: valid(kind, s["value"]))
    nth, name = F.lit(KINDS.index(kind)).alias("nth"), F.lit(kind).alias("kind")
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), nth, name, s["end"].alias("end"), s["scope"].alias("scope")))


def any_of(values: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, values)


def parts(texts: DataFrame) -> DataFrame:
    """One row for each part ``key, start, nth, kind, end, scope`` of texts that may hold an incomplete credential.

    Those texts have a weak candidate and parts of at least two classes. Copies count once.
    """
    weak = any_of([F.col("text").rlike(WEAK[k]) for k in WEAK])
    found = texts.where(weak).select("key", F.concat(*[detected(F.col("text"), k, scopes=True) for k in KINDS]).alias("parts"))
    classes = F.array_distinct(F.transform("parts", lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv]), p["kind"])))
    found = found.where(F.size(classes) > 1).dropDuplicates(["key"])
    return found.select("key", F.explode("parts").alias("p")).select("key", "p.*")


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts whose complements stand within ``reach`` characters in the same scope: ``key, weak`` (an array of spans).

    A complement may stand before, after or across the part. For each class the nearest end before and the nearest start
    after follow from running extremes in order of position.
    """
    scope = Window.partitionBy("key", "scope")
    rising = scope.orderBy("start", "nth", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = scope.orderBy(F.desc("start"), F.desc("nth"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def of_class(name: str) -> Column:
        return F.col("kind").isin([k for k in KINDS if CLASS[k] == name])

    names = sorted(set(CLASS.values()))
    seen = rows.select("*", *[F.max(F.when(of_class(c), F.col("end"))).over(rising).alias(f"{c}_before") for c in names])
    seen = seen.select("*", *[F.min(F.when(of_class(c), F.col("start"))).over(falling).alias(f"{c}_after") for c in names])

    def near(name: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{name}_after") - F.col("end") <= reach, F.lit(False))

    complete = any_of([(F.col("kind") == k) & reduce(lambda a, b: a & b, map(near, needs)) for k, needs in NEEDS.items()])
    part = F.struct("start", "nth", "kind", "end", "scope")
    return seen.where(complete).groupBy("key").agg(F.collect_list(part).alias("weak"))


def with_links(rows: DataFrame, texts: DataFrame, key: str, weak: str, reach: int) -> DataFrame:
    """``rows`` with the array ``weak`` of the linked weak parts of their text; ``key`` holds a hash of it.

    ``texts`` has ``key, text``. Links of up to ``SMALL`` bytes, as counted, are broadcast, so that ``rows`` stay in
    place; more are joined by a shuffle, and their size is known to it, so that it can split the rows of a frequent text.
    """
    links = stored(linked(parts(texts), reach)).withColumnsRenamed({"key": key, "weak": weak})
    bytes_held = links.agg(F.sum(F.size(weak) * SPAN_BYTES + SPAN_BYTES)).first()[0] or 0
    nothing = F.array().cast("array<struct<start:bigint,nth:int,kind:string,end:bigint,scope:bigint>>")
    if bytes_held <= SMALL:
        return rows.join(F.broadcast(links), key, "left").withColumn(weak, F.coalesce(weak, nothing))
    return rows.join(links, key, "left").withColumn(weak, F.coalesce(weak, nothing))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``start, nth, kind, end, scope`` by start, then kind as listed.

    ``base`` has the base kinds, ``spans`` the linked weak parts as well. One row for each row of ``docs``; a NULL text is
    empty and has no spans. Positions count code points, ends are exclusive.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    texts = docs.select(docs[id_column].alias("doc_id"), text.alias("text")).withColumn("key", F.sha2("text", 256))
    # Base spans are found before the join, which then moves no texts.
    base = F.array_sort(F.concat(*[detected(F.col("text"), k) for k in BASE]))
    rows = with_links(texts.select("doc_id", base.alias("base"), "key"), texts.select("key", "text"), "key", "weak", reach)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "weak")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans and all spans as text."""

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``MASK``; spans come in order of their starts.

    What lies between runs is cut out of pieces of the text that hold about as many gaps as there are pieces, since
    finding a position in a text means passing all characters before it.
    """
    nothing = F.array().cast("array<string>")

    def gaps(heads: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(heads))).cast("int")

        def of_piece(part: Column) -> Column:
            first, last = F.get(part, F.lit(0))["after"], F.get(part, F.size(part) - 1)["start"]
            piece = F.substring(text, first + 1, last - first)
            return bind(piece, lambda p: F.transform(part, lambda h: F.substring(p, h["after"] - first + 1, h["start"] - h["after"])))

        firsts = F.sequence(F.lit(0), F.size(heads) - 1, width)
        return F.flatten(F.transform(firsts, lambda i: bind(F.slice(heads, i + 1, width), of_piece)))

    def runs(ends: Column) -> Column:
        """Where each run starts, and where the one before ends."""
        before = running_totals(ends, combine=lambda x, y: F.greatest(x, y))
        both = F.zip_with(F.transform(found, lambda s: s["start"]), before, lambda s, e: F.struct(e.alias("after"), s.alias("start")))
        return F.filter(both, lambda h: h["start"] >= h["after"])

    def of(ends: Column) -> Column:
        tail = F.substring(text, F.array_max(ends) + 1, F.char_length(text))
        kept = bind(runs(ends), lambda heads: F.when(F.size(heads) > 0, gaps(heads)).otherwise(nothing))
        return F.concat(F.array_join(kept, MASK), F.lit(MASK), tail)

    return F.when(F.size(found) == 0, text).otherwise(bind(F.transform(found, lambda s: s["end"]), of))


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", reach: int = REACH) -> DataFrame:
    """``docs`` with all their rows and columns, secrets masked; ``length_column``, where given, follows the new text."""
    key, weak, found = fresh(docs, "key"), fresh(docs, "weak"), fresh(docs, "found")
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = F.concat(*[detected(text, k) for k in BASE])
    keyed = docs.withColumn(key, F.sha2(text, 256))
    texts = keyed.select(F.col(key).alias("key"), text.alias("text"))
    rows = with_links(keyed, texts, key, weak, reach).withColumn(found, F.array_sort(F.concat(base, F.col(weak))))
    changed = F.size(found) > 0
    rows = rows.withColumn(text_column, F.when(changed, masked(F.col(text_column), F.col(found))).otherwise(F.col(text_column)))
    if length_column:
        kind = docs.schema[length_column].dataType
        rows = rows.withColumn(length_column, F.when(changed, F.char_length(text_column).cast(kind)).otherwise(F.col(length_column)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
