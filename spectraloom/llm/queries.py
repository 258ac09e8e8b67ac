"""Registered queries of the operators; ``SQL`` states those that SQL can express.

Each query applies its operator with production parameters to whole tables and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import conversations, ctph, langid, packing, pieces, pii, secrets, sharding, simhash, topk, toxicity, warc, whitening
from spectraloom.llm.common import remainder, small_batches
from spectraloom.llm.sql import SQL  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, folder, "documents")))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learn_languages(langid.taught(docs))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held, "lang_pred", "score")


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def capture_records(pages: DataFrame) -> DataFrame:
    """A crawl of the pages as archive records: a full response of each page, a later or earlier conditional request under
    another spelling of its URL, and a request of one script that all pages share, mostly answered "not modified"."""
    later = "3600 * (1 + page_id % 5) - if(page_id % 11 = 0, 100000, 0)"
    spelled = (
        "case page_id % 4 when 0 then concat(url, '#again') when 1 then replace(url, '://', '://www.') when 2 then replace(url, 'http', 'HTTP') "
        "else concat(url, if(contains(url, '?'), '&', '?'), 'utm_source=mail') end"
    )
    etag, script = "concat('\"', substr(md5(html), 1, 12), '\"')", "concat('\"v', cast(page_id div 500 as string), '\"')"
    validators = (
        f"case page_id % 7 when 0 then map('etag', '\"other\"') when 1 then map('Last-Modified', concat('day ', page_id % 50)) "
        f"when 2 then map('Via', 'proxy') else map('ETag', concat('W/', {etag})) end"
    )
    at = "1000000 + (page_id * 7919 % 100003) * 60"
    first = (
        f"struct(4 * page_id as record_id, 'response' as kind, url as url, {at} as s, 200 as status, "
        f"map('ETag', {etag}, 'Last-Modified', concat('day ', page_id % 50), 'Content-Type', 'text/html', "
        "'Content-Length', cast(length(html) as string), 'Server', 'one') as headers, md5(html) as digest)"
    )
    again = (
        f"struct(4 * page_id + 1 as record_id, 'revisit' as kind, {spelled} as url, {at} + {later} as s, 304 as status, "
        f"map_concat({validators}, map('Cache-Control', concat('max-age=', page_id % 100), 'Content-Length', '0', 'Server', 'two')) as headers, "
        "cast(null as string) as digest)"
    )
    shared = (
        "struct(4 * page_id + 2 as record_id, if(page_id % 50 = 0, 'response', 'revisit') as kind, "
        "concat('https://static.example.com:443/site.js?sid=', page_id) as url, 1000000 + page_id * 10 as s, "
        f"if(page_id % 50 = 0, 200, 304) as status, map('ETag', {script}) as headers, "
        "if(page_id % 50 = 0, cast(page_id as string), cast(null as string)) as digest)"
    )
    seconds = pages.select(F.explode(F.array(*map(F.expr, (first, again, shared)))).alias("r"))
    return seconds.select("r.*").withColumn("at", F.timestamp_seconds("s")).drop("s")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve_revisits(capture_records(table(spark, folder, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    found = toxicity.classify(docs, table(spark, folder, "labels"), ["doc_id"])
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return ctph.compare_edits(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(table(spark, folder, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whitening.whole_numbers(table(spark, folder, "embeddings"))
    return whitening.whiten(vectors, whitening.learn_whitening(vectors)).withColumnRenamed("id", "vec_id")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by a checksum of their key, and how many times each row stands then."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault, text = F.crc32(F.concat_ws(":", *key)) % 20, F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("stands")), F.col("stands")


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns, copies = damaged(table(spark, folder, "conversations"))
    found, rows = conversations.repair(turns, copies=copies)
    hashes = conversations.digests(rows, found).withColumnRenamed("conv", "conv_")
    whole = found.join(hashes, F.col("conv").eqNullSafe(F.col("conv_")))
    return whole.drop("conv_").withColumnRenamed("conv", "conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_pieces": op3_pieces,
    "op4_topk": op4_topk,
    "op5_secrets": op5_secrets,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_conversations": op13_conversations,
}
