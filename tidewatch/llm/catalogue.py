"""Registered queries of the ten operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import new_path
from . import bloom_cascade, decontaminate, embedding_dedup, minhash_forest, mixing, secret_scan, sharding, token_store, toxicity, warc
from .oracles import ORACLE_SQL, SHARDS

__all__ = ["ORACLE_SQL", "QUERIES"]

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LISTED_HOST = r"(^|\.)(ads?|track(er|ing)?|banner|click)[-.]"
FOREIGN = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl's records: for each page its full response, and a later or earlier revisit that names the same ETag.

    Responses are a second apart; revisits come -1, 0, 1 or 2 days after, by the length of the URL. The times are arbitrary,
    so that revisits meet no response, their own or a later capture of the same canonical URL."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("page_id") * 1_000_000)
    days = F.length("url") % 4 - 1
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    size = F.length("html").cast("string")
    full = F.create_map(F.lit("ETag"), etag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), size, F.lit("Cache-Control"), F.lit("max-age=60"))
    fresh = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("content-length"), F.lit("0"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string")), F.lit("Date"), F.col("page_id").cast("string"))
    responses = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("time"), F.lit(200).alias("status"), full.alias("headers"))
    revisits = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + F.make_dt_interval(days)).alias("time"), F.lit(304).alias("status"), fresh.alias("headers"))
    return responses.unionByName(revisits)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "source_id", "state", "body_id", lines.alias("headers"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.scratch import keep

    docs = table(spark, sf_dir, "documents")
    sized = keep(docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("_size"), mixing.place_of(F.col("doc_id"), F.col("text")).alias("_tie")), "sized")
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_documents(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), tokenizer_path())
    return token_store.read_documents(manifest, token_store.crc32, "ids_crc32", T.LongType())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    counts = [secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(secret_scan.base_only(spans)), 256).alias("base_sha256"), secret_scan.written(spans).alias("spans"))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def blocklist(pages: DataFrame) -> DataFrame:
    """A list of hosts and of hosts with paths: those with a label like ads, an eighth of all others by a hash, and FOREIGN keys that no page has."""
    host, path = bloom_cascade.host_and_path(F.col("url"))
    keys = pages.select(F.explode(F.array(host, F.concat(host, path))).alias("key")).distinct()
    own = keys.where(F.regexp_extract("key", "^[^/]*", 0).rlike(LISTED_HOST) & ~F.col("key").contains("/") | (F.md5("key") < "2"))
    foreign = pages.sparkSession.range(FOREIGN).select(F.concat(F.lit("host-"), F.col("id").cast("string"), F.lit(".invalid")).alias("key"))
    return own.unionByName(foreign)


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return bloom_cascade.judge(pages, RULES, blocklist(pages)).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", list(SHARDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    f.__name__: f
    for f in (op1_warc_revisits, op2_decontamination, op3_mixing, op4_token_store, op5_embedding_dedup, op6_secret_scan, op7_minhash_forest, op8_toxicity, op9_bloom_cascade, op10_sharding, pipeline)
}
