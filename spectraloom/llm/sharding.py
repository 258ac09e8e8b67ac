"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are a group. Groups that weigh a grain of a shard or more (at most three times as many as there are
grains) are placed one by one; all others travel in bundles by a hash of their text, so the driver packs a bounded number of
items whatever the number of documents. From the heaviest on, an item goes to the shard where the dot product of its vector
with the residual capacity is highest. A group that weighs more than a grain is counted and numbered in parts, by a hash of
its identifiers and, for copies of one identifier, by number, so that none fills a task. Its parts are one item as long as
the group fits a shard; those of a larger one are items of their own, so that none unbalances the shards.

Texts are read once and stay where they are: sizes and digests of them are what is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.plans.lineage import cut

SHARDS = 40
#: Grains a shard is thought of as: a bundle weighs about one, and parts of a large group as much.
GRAIN = 256
#: What a group may weigh, in shards, and stay together.
LARGEST = 1.0
#: Bytes a row takes besides its text.
ROW_BYTES = 16
WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, a row of weights per item: the one where the dot product with what is left is highest.

    Weights count in units of a shard's fair share. Items go from the one with the largest weight to the smallest, equal ones
    in their order; of shards that suit equally the first is taken.
    """
    fair = items.sum(axis=0) / shards
    weights = items / np.where(fair > 0, fair, 1.0)
    left, found = np.ones((shards, items.shape[1])), np.zeros(len(items), int)
    for item in np.argsort(-weights.max(axis=1, initial=0.0), kind="stable"):
        found[item] = shard = int(np.argmax(left @ weights[item]))
        left[shard] -= weights[item]
    return found


def settle(items: np.ndarray, found: np.ndarray, shards: int, rounds: int = 10_000) -> np.ndarray:
    """Evens out the first weight: as long as it helps, the fullest shard gives an item to the emptiest or swaps two with it.

    The item moved, or the difference swapped, is the one nearest to half of what lies between the two shards.
    """
    found, weight = found.copy(), items[:, 0]
    filled = np.bincount(found, weight, shards)
    for _ in range(rounds):
        most, least = int(filled.argmax()), int(filled.argmin())
        gap = filled[most] - filled[least]
        own, other = np.flatnonzero(found == most), np.flatnonzero(found == least)
        if gap <= 0 or not len(own):
            break
        order = other[np.argsort(weight[other], kind="stable")]
        # Giving an item for none is a swap with an item of no weight.
        offers = np.append(0.0, weight[order])
        wanted = weight[own] - gap / 2
        at = np.searchsorted(offers, wanted).clip(1, len(offers)) if len(offers) > 1 else np.ones(len(own), int)
        choices = np.stack([at - 1, np.minimum(at, len(offers) - 1)])
        moved = weight[own][None, :] - offers[choices]
        miss = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
        row, col = np.unravel_index(int(miss.argmin()), miss.shape)
        if not np.isfinite(miss[row, col]):
            break
        given, taken = own[col], choices[row, col]
        found[given] = least
        filled[most] -= weight[given]
        filled[least] += weight[given]
        if taken:
            back = order[taken - 1]
            found[back] = most
            filled[most] += weight[back]
            filled[least] -= weight[back]
    return found


def slim_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, key, size, crc, tokens, copies``: one row per identifier and text; texts are told apart by digest, size and crc."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    narrow = docs.select(
        docs[id_column].alias("id"), F.unhex(F.md5(text)).alias("key"), size.alias("size"), F.crc32(text).alias("crc"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )
    return narrow.groupBy("id", "key", "size", "crc", "tokens").agg(F.count(F.lit(1)).alias("copies"))


def weighed(rows: DataFrame, *by: str) -> DataFrame:
    parts = [F.sum(F.col("copies") * F.col("size")).alias("bytes"), F.sum(F.col("copies") * F.col("tokens")).alias("words"), F.sum("copies").alias("rows")]
    return rows.groupBy(*by).agg(*parts)


def shard(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", grain: int = GRAIN, largest: float = LARGEST
) -> DataFrame:
    """A row per document: ``doc_id, size, text_crc32, shard`` and ``slot``, its place in the shard, gapless from 0.

    ``size`` counts the UTF-8 bytes of the text and 16 more. Sizes of shards come out as near to equal as whole groups allow;
    tokens (words) and rows are balanced along with them. A NULL text counts as an empty one. Repeated rows are rows of their
    own; NULL identifiers are one identifier. The same rows are dealt alike under any partitioning.
    """
    rows = cut(slim_rows(docs, id_column, text_column))
    total = weighed(rows).first()
    if not total or not total.rows:
        return rows.selectExpr("id as doc_id", "size", "crc as text_crc32", "0 as shard", "0L as slot")
    fair = {name: max(total[name], 1) / shards for name in ("bytes", "words", "rows")}
    share = F.greatest(*[F.col(name) / F.lit(float(w)) for name, w in fair.items()])
    groups = weighed(rows, "key", "size", "crc").withColumn("share", share)
    heavy = groups.where(F.col("share") >= 1 / grain).select("key", "size", "crc", "share").orderBy("key", "size", "crc").collect()
    bundles, first, known, together = shards * grain, shards * grain, [], []
    for group in heavy:
        parts = int(np.ceil(group.share * grain))
        known.append((bytes(group.key), group.size, group.crc, first, parts))
        together += [first] * parts if group.share <= largest else range(first, first + parts)
        first += parts
    session, keys = docs.sparkSession, ["key", "size", "crc"]
    numbered = F.broadcast(session.createDataFrame(known, "key binary, size long, crc long, first int, parts int"))
    limit = max(total.rows // (shards * grain), 1)
    # Copies of one identifier in a large group are dealt out a bounded number at a time.
    pieces = F.when(F.col("parts") > 1, F.ceil(F.col("copies") / limit)).otherwise(1).cast("int")
    rows = rows.join(numbered, keys, "left").select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), pieces.alias("pieces"))
    held = F.floor(F.col("copies") / F.col("pieces")) + (F.col("piece") < F.col("copies") % F.col("pieces")).cast("long")
    own = F.col("first") + F.pmod(F.xxhash64("id", "piece"), F.col("parts"))
    item = F.coalesce(own, F.pmod(F.xxhash64(*keys), F.lit(bundles))).cast("int")
    rows = rows.withColumn("copies", F.when(F.col("pieces") > 1, held).otherwise(F.col("copies"))).withColumn("item", item)

    items = weighed(rows, "item").orderBy("item").toArrow()
    weights = np.column_stack([items.column(name).to_numpy() for name in ("bytes", "words", "rows")]).astype(float)
    # What is placed as one: the first part of a group stands for all that stay together.
    unit_of = np.array([*range(bundles), *together])[items.column("item").to_numpy()]
    _, units = np.unique(unit_of, return_inverse=True)
    joint = np.stack([np.bincount(units, w) for w in weights.T], axis=1)
    found = settle(joint, place(joint, shards), shards)[units]
    counts = items.column("rows").to_numpy()
    before = np.zeros(len(found), int)
    for s in range(shards):
        inside = found == s
        before[inside] = np.cumsum(counts[inside]) - counts[inside]
    places = list(zip(items.column("item").to_pylist(), found.tolist(), before.tolist()))
    placed = rows.join(F.broadcast(session.createDataFrame(places, "item int, shard int, before long")), "item")
    so_far = Window.partitionBy("item").orderBy("id", "key", "size", "crc", "piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.col("before") + F.sum("copies").over(so_far))
    slots = F.explode(F.sequence(F.col("end") - F.col("copies"), F.col("end") - 1)).alias("slot")
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", slots)
