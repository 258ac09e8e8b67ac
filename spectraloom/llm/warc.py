"""Resolution of "not modified" revisits in web archives.

A revisit record (status 304) has no body: it says that a page is as it was. It is resolved by an as-of join: the latest
earlier full response of the same canonical URL, whose validators must agree with the revisit's. The result has the response's
headers, updated by those a 304 may change, and refers to the response's body, which stays where it is.

The join is one ordered pass over the records of a URL. A URL with more records than two even shuffle partitions (and than
``CROWDED``) is cut into stretches of time first; each stretch is passed on its own and begins with the last response of
the stretches before, so no task gets all records of a frequent URL. A crowded instant is a stretch that needs no pass: its
revisits all refer to what the stretches before leave behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import stored
from spectraloom.plans.lineage import cut

#: URLs with no more records than this are passed in one go.
CROWDED = 500
#: A crowded time is cut into so many intervals for each stretch that its records fill.
FINE = 32
#: Tables of no more rows than this, with a row for each crowded URL, interval or stretch, are broadcast.
FEW = 10_000

# Headers that describe the transfer or the body of one message, and stay those of the stored response.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name a visit and not a page.
VISIT_PARAMETERS = ("phpsessid", "jsessionid", "sid", "sessionid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without a leading ``www.``, user, default port, fragment and visit parameters;
    parameters in order, no slash at the end, http for https. NULL for NULL; other texts are trimmed and lower-cased."""
    text = F.trim(url)
    pattern = r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"

    def group(n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    host = F.regexp_replace(F.lower(group(1)), r"^www\.|\.$", "")
    port = F.when(group(2).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), group(2)))
    path = F.regexp_replace(F.regexp_replace(group(3), "//+", "/"), "/$", "")
    named = F.filter(F.split(group(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*VISIT_PARAMETERS))
    query = F.array_join(F.array_sort(named), "&")
    address = F.concat(F.lit("http://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(text.rlike(pattern), address).otherwise(F.lower(text))


def lower_keys(headers: Column) -> Column:
    """Headers by lower-case name, NULL as none; of names that differ in case only the first stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, 1, i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(first)


def tag(headers: Column) -> Column:
    """The entity tag, compared weakly: without its ``W/``."""
    return F.regexp_replace(F.trim(F.try_element_at(headers, F.lit("etag"))), "^W/", "")


def modified(headers: Column) -> Column:
    return F.trim(F.try_element_at(headers, F.lit("last-modified")))


def agreement(revisit: Column, response: Column) -> Column:
    """``match``, ``mismatch`` or ``unchecked``: by entity tags if both have one, else by the dates of modification."""
    tags = tag(revisit).isNotNull() & tag(response).isNotNull()
    dates = modified(revisit).isNotNull() & modified(response).isNotNull()
    same = F.when(tags, tag(revisit) == tag(response)).when(dates, modified(revisit) == modified(response))
    return F.when(same, "match").when(~same, "mismatch").otherwise("unchecked")


def merged(revisit: Column, response: Column) -> Column:
    """The response's headers, updated by the revisit's, but for those that belong to one message."""
    new = F.map_filter(revisit, lambda k, _: ~k.isin(*KEPT_HEADERS))
    names = F.map_keys(new)
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.array_contains(names, k)), new)


def small(df: DataFrame) -> DataFrame:
    """A fixed table, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def intervals(records: DataFrame, most: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """``records`` with the start ``lo`` of the interval of time they are in, NULL but for URLs with more than ``crowded``;
    and the intervals, ``url, lo, first, last, n``, with more than ``most`` records only in an instant.

    The time of a URL is cut into equal intervals by its span. Those that hold too many still, as in a burst between
    outliers, are cut again by their own span. Every round divides it by ``FINE`` at least, so there are few.
    """
    span = [F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")]
    grain = F.ceil((F.col("last") - F.col("first") + 1) / F.ceil(FINE * F.col("n") / most)).cast("long").alias("grain")
    start = F.col("first").alias("start")
    placed, key = records.withColumn("lo", F.lit(None).cast("long")), ["url"]
    wide = cut(records.groupBy("url").agg(*span).where(F.col("n") > crowded))
    while True:
        inner = small(cut(wide.select(*key, start, grain)))
        placed = placed.join(inner, key, "left").withColumn("lo", F.coalesce(F.expr("start + ((at - start) div grain) * grain"), "lo")).drop("start", "grain")
        found, key = cut(placed.where(F.col("lo").isNotNull()).groupBy("url", "lo").agg(*span)), ["url", "lo"]
        wide = found.where((F.col("n") > most) & (F.col("last") > F.col("first")))
        if wide.isEmpty():
            return placed, found


def stretches(records: DataFrame, crowded: int) -> DataFrame:
    """``records`` with the number of the stretch of time they are in, 0 but for URLs with more than ``crowded`` records, and
    whether it is a crowded ``instant``.

    Neighbouring intervals are joined until they hold about half of ``crowded`` records, and never more than ``crowded``,
    but for instants with more than half of it, which stay alone. Stretches rise with time.
    """
    half = max(1, crowded // 2)
    placed, found = intervals(records, half, crowded)
    before = Window.partitionBy("url").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("n") > half
    # What follows a crowded instant has passed another half at least: odd numbers are its own.
    number = 2 * F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / half) + alone.cast("long")
    numbered = small(cut(found.select("url", "lo", number.alias("stretch"), alone.alias("instant"))))
    whole = {"stretch": F.coalesce("stretch", F.lit(0).cast("long")), "instant": F.coalesce("instant", F.lit(False))}
    return placed.join(numbered, ["url", "lo"], "left").withColumns(whole).drop("lo")


def resolve_revisits(records: DataFrame, crowded: int | None = None) -> DataFrame:
    """One row for each revisit: ``record_id, url, outcome, refers_to, headers, digest``.

    ``records`` has ``record_id, kind, url, at, status, headers, digest``: ``kind`` is ``response`` or ``revisit`` (others are
    passed over), full responses have status 200, ``at`` is a timestamp. Further columns are ignored. ``url`` comes back in
    canonical form. ``outcome``: ``resolved``; ``unchecked`` where revisit and response have no validator in common;
    ``mismatch`` where it differs; ``missing`` without an earlier full response, or without URL or time. The other columns
    are NULL for the last two. URLs with more than ``crowded`` records are passed in stretches of about half as many.
    Earlier is strictly earlier; of responses at one instant the largest ``record_id`` counts. Revisits with the same
    ``record_id``, exact copies too, give a row each; of responses with the same ``record_id`` and time the largest counts,
    by digest, then headers.
    """
    known = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "digest", canonical_url(F.col("url")).alias("url"), F.unix_micros("at").alias("at"),
        lower_keys(F.col("headers")).alias("headers"), ((F.col("kind") == "response") & F.coalesce(F.col("status") == 200, F.lit(False))).alias("full"),
    )
    known = known.where((F.col("kind") == "revisit") | F.col("full"))
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, without bodies: what follows reads times first, and headers only where they are needed.
    known = stored(known)
    if crowded is None:
        crowded = max(CROWDED, 2 * known.count() // partitions)
    placed = F.col("url").isNotNull() & F.col("at").isNotNull()
    cutting = stretches(known.where(placed), crowded)
    # Arrays of headers can be compared, which a maximum over records needs; time and identifier decide.
    candidate = F.when(F.col("full"), F.struct("at", "record_id", "digest", F.array_sort(F.map_entries("headers")).alias("headers")))
    # Records of a crowded instant see none before them in their stretch: these are dealt out anyhow.
    cell = F.when(F.col("instant"), F.pmod(F.xxhash64("record_id"), F.lit(partitions))).otherwise(0).alias("cell")
    earlier = Window.partitionBy("url", "stretch", "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = cutting.withColumn("cell", cell).withColumn("found", F.max(candidate).over(earlier)).where("kind = 'revisit'")
    # What the stretches before leave behind, for crowded URLs.
    last = cutting.groupBy("url", "stretch").agg(F.max(candidate).alias("left"))
    before = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = small(cut(last.withColumn("carried", F.max("left").over(before)).where("stretch > 0").select("url", "stretch", "carried")))
    seen = seen.join(carried, ["url", "stretch"], "left").withColumn("found", F.coalesce("found", "carried"))
    lost = known.where(~placed & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(seen.schema["found"].dataType))
    columns = ["record_id", "url", "headers", "found"]
    both = seen.select(columns).unionAll(lost.select(columns))
    response = F.map_from_entries("found.headers")
    agreed = F.when(F.col("found").isNull(), "missing").otherwise(agreement(F.col("headers"), response))
    outcome = F.when(agreed == "match", "resolved").otherwise(agreed)
    good = agreed.isin("match", "unchecked")
    return both.select(
        "record_id", "url", outcome.alias("outcome"), F.when(good, F.col("found.record_id")).alias("refers_to"),
        F.when(good, merged(F.col("headers"), response)).alias("headers"), F.when(good, F.col("found.digest")).alias("digest"),
    )
