"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most r bits are found exactly. The 64 bits are cut into parts, correlated bits together;
part i gets a threshold t_i of its own (-1: not looked at) with sum(t_i + 1) = r + 1. Two fingerprints within r bits are
then within t_i bits on at least one part. The parts and thresholds are those with the smallest estimated number of
candidates, found by dynamic programming on how often equal values occur in each part.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket with more than ``DENSE`` fingerprints
isn't expanded into pairs: its members announce the fingerprints within half the distance of themselves, and those who
meet at one of these are linked to the smallest there. That finds the same groups with rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import fresh
from spectraloom.plans.lineage import cut

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Buckets with more fingerprints are not expanded into pairs.
DENSE = 32
#: Shingles hashed together, to bound memory on long texts.
BLOCK = 100_000


# ---- fingerprints -------------------------------------------------------------------------------------------------


def simhash(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a whole text. Only A-Z are lower-cased; words lie between ASCII white space. No words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = ends[min(words_per_shingle, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        spans = zip(starts[i : min(n, i + BLOCK)].tolist(), ends[i : min(n, i + BLOCK)].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words_per_shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [simhash(t, words_per_shingle) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return run(text)


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


# ---- parts and thresholds -----------------------------------------------------------------------------------------


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how often both are set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            own = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(own, axis=1, bitorder="little").astype(np.float32)
            total, both = total + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BITS * BITS), -1)), pa.array(np.append(both.ravel(), total).astype(np.int64))], ["at", "n"])

    sums = prints.select("print").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = {r.at: r.n for r in sums.collect()}  # 4097 numbers
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size; each grows by the bit most correlated with those it has."""
    mean = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs((both / max(total, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for p in range(parts):
        size = (BITS * (p + 1)) // parts - (BITS * p) // parts
        group = [max(left, key=lambda b: (related[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], max_bits: int) -> list[int]:
    """Thresholds of least total cost with sum(t + 1) = max_bits + 1; ``costs[i][t + 1]`` is what threshold t costs part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        reached: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra, own in enumerate(part):
                at = used + extra
                if at <= max_bits + 1 and (at not in reached or cost + own < reached[at][0]):
                    reached[at] = cost + own, [*chosen, extra - 1]
        best = reached
    return best[max_bits + 1][1]


def flips(width: int, distance: int) -> list[int]:
    """Masks of up to ``distance`` bits out of ``width``, zero first."""
    masks = [0]
    for _ in range(distance):
        masks = list(dict.fromkeys(masks + [m | 1 << b for m in masks for b in range(width)]))
    return masks


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def equal_pairs(prints: DataFrame, masks: list[int]) -> list[float]:
    """For each part: pairs of fingerprints that are equal there, counted over all."""
    part = F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("part", "mask")
    values = prints.select("print", part).groupBy("part", F.col("print").bitwiseAND(F.col("mask"))).count()
    n = F.col("count").cast("double")
    found = {r.part: r.pairs for r in values.groupBy("part").agg(F.sum(n * (n - 1) / 2).alias("pairs")).collect()}
    return [found.get(i, 0.0) for i in range(len(masks))]


def plan(prints: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Parts and their thresholds: of all numbers of parts up to max_bits + 1, the one with the least estimated cost."""
    total, both = bit_moments(prints)
    mean = np.diag(both) / max(total, 1)
    differs = np.clip(2 * mean * (1 - mean), 0, 0.5)
    options = [correlated_parts(total, both, m) for m in range(1, max_bits + 2)]
    equal = iter(equal_pairs(prints, [mask_of(g) for groups in options for g in groups]))
    found = []
    for groups in options:
        costs = []
        for group in groups:
            pairs, ratio = next(equal), differs[group] / (1 - differs[group])
            # Pairs at exactly d differing bits over those at none: elementary symmetric sums of the bits' odds.
            shares = reduce(lambda a, r: [x + (a[i - 1] * r if i else 0) for i, x in enumerate(a)], ratio, [1.0] + [0.0] * max_bits)
            near = np.cumsum(shares) * max(pairs, 1)
            probes = [len(flips(len(group), t)) * total for t in range(max_bits + 1)]
            costs.append([0.0, *(near + probes)])
        chosen = allocate(costs, max_bits)
        found.append((sum(c[t + 1] for c, t in zip(costs, chosen)), list(zip(groups, chosen))))
    return [(g, t) for g, t in min(found, key=lambda f: f[0])[1] if t >= 0]


# ---- links --------------------------------------------------------------------------------------------------------


def spread_bits(group: list[int], distance: int) -> list[int]:
    return [signed(sum(1 << group[b] for b in range(len(group)) if m >> b & 1)) for m in flips(len(group), distance)]


def links(prints: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints within ``max_bits`` bits.

    Every two such fingerprints are linked or joined by a chain of links; no link is longer.
    """
    parts = plan(prints, max_bits) if parts is None else parts
    entries = []
    for number, (group, threshold) in enumerate(parts):
        value = F.col("print").bitwiseAND(F.lit(signed(mask_of(group))))
        around = F.posexplode(F.array(*map(F.lit, spread_bits(group, threshold)))).alias("nth", "flip")
        probes = prints.select("print", value.alias("value"), around)
        entries.append(probes.select(F.lit(number).alias("part"), F.col("value").bitwiseXOR(F.col("flip")).alias("key"), "print", (F.col("nth") == 0).alias("own")))
    entries = reduce(DataFrame.unionAll, entries)
    # Stored, so that joins with it see its size, and can split a large bucket's rows among tasks.
    crowded = cut(entries.where("own").groupBy("part", "key").count().where(F.col("count") > dense).select("part", "key"))

    few = entries.join(crowded, ["part", "key"], "left_anti")
    here, there = few.where("own").alias("h"), few.alias("t")
    met = here.join(there, (F.col("h.part") == F.col("t.part")) & (F.col("h.key") == F.col("t.key")))
    apart = F.bit_count(F.col("h.print").bitwiseXOR(F.col("t.print")))
    pairs = met.where((F.col("h.print") != F.col("t.print")) & (apart <= max_bits)).select(F.col("h.print").alias("a"), F.col("t.print").alias("b"))

    members = entries.join(crowded, ["part", "key"], "left_semi").select("print").distinct()
    near, far = max_bits // 2, (max_bits + 1) // 2
    # Anyone within `near` of a middle and anyone within `far` of it are at most max_bits apart.
    middles = F.posexplode(F.array(*map(F.lit, spread_bits(list(range(BITS)), far)))).alias("nth", "flip")
    close = F.col("nth") < len(flips(BITS, near))
    rays = members.select("print", middles).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("middle"), close.alias("close"))
    least = F.min(F.when(F.col("close"), F.col("print"))).alias("a")
    # All fingerprints this near to one middle: a bounded number.
    stars = rays.groupBy("middle").agg(least, F.collect_set("print").alias("around")).where(F.col("a").isNotNull() & (F.size("around") > 1))
    return pairs.unionAll(stars.select("a", F.explode("around").alias("b")).where("a != b"))


# ---- components ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the smallest node that can be reached.

    Each round every node, and the root it has so far, learns the smallest root around it; then roots are followed two
    steps up. The number of rounds grows with the logarithm of the longest chain.
    """
    both = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(state.withColumnsRenamed({"node": "b"}), "b").select(F.col("a").alias("node"), F.col("root").alias("seen"))
        known = state.select("node", "root")
        heard = around.join(known, "node").select(F.col("root").alias("node"), "seen")
        heard = around.unionAll(heard).unionAll(known.select("node", F.col("root").alias("seen")))
        # The own root rides along, so that a change shows.
        told = heard.withColumn("was", F.lit(None).cast("long")).unionAll(known.select("node", F.col("root"), F.col("root").alias("was")))
        new = cut(told.groupBy("node").agg(F.min("seen").alias("root"), F.max("was").alias("was")))
        for _ in range(2):
            up = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
            new = cut(new.join(up, "root").select("node", F.col("above").alias("root"), "was"))
        state = new.select("node", "root")
        if new.where("root != was").isEmpty():
            return state


# ---- documents ----------------------------------------------------------------------------------------------------


def grouped_prints(prints: DataFrame, max_bits: int) -> DataFrame:
    """``print, root`` of distinct fingerprints that are linked to others."""
    return components(links(prints, max_bits))


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``, repeated rows included.

    Fingerprints of ``max_bits`` differing bits or fewer are linked; ``component_id`` is the smallest ``doc_id`` that can
    be reached, NULL only where all are NULL. NULL and empty texts have fingerprint zero.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), fingerprint(docs[text_column], words_per_shingle).alias("print"))
    rows = cut(rows)
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = grouped_prints(prints.select("print"), max_bits).withColumnsRenamed({"node": "print"})
    root = F.coalesce("root", "print").alias("root")
    rooted = cut(prints.join(roots, "print", "left").select("print", "least", root))
    lowest = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(lowest, "root").select("print", "component_id"))
    return rows.join(named, "print").select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their groups: the smallest ``doc_id`` of each.

    Of rows with that ``doc_id`` one stays (by a hash of its columns); a group without identifiers keeps the row with the
    smallest such hash.
    """
    own, key = fresh(docs, "print"), fresh(docs, "row")
    content = F.sha2(F.to_json(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256)
    keyed = docs.withColumn(key, content)
    rows = cut(keyed.select(F.col(id_column).alias("doc_id"), F.col(key).alias("row"), fingerprint(F.col(text_column), words_per_shingle).alias("print")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    prints = cut(rows.groupBy("print").agg(F.min(rank).alias("least")))
    roots = grouped_prints(prints.select("print"), max_bits).withColumnsRenamed({"node": "print"})
    rooted = prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    chosen = cut(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(key)).distinct())
    # Repeats of a row collapse in each task before they are dealt out, and the join goes by the same key.
    return keyed.dropDuplicates([key]).join(chosen, key, "left_semi").drop(key, own)
