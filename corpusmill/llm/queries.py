"""The thin queries opN_<name>, their registry, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import mixing, secrets
from corpusmill.llm.common import shared_dir, stash, table
from corpusmill.llm.exact_dedup import exact_dedup
from corpusmill.llm.fim import fill_in_middle, restored
from corpusmill.llm.line_dedup import keep_bitmaps, kept_text
from corpusmill.llm.packing import best_fit_pack
from corpusmill.llm.quality import score_quality
from corpusmill.llm.simhash import simhash_components
from corpusmill.llm.sql import ORACLE_SQL  # noqa: F401
from corpusmill.llm.topk import top_k
from corpusmill.llm.toxicity import score_toxicity
from corpusmill.llm.trie import prefix_trie
from corpusmill.llm.urls import judge_urls
from corpusmill.llm.warc import archive_pages


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_pack(table(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048, ids=False, digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, tau=3)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = keep_bitmaps(table(spark, sf_dir, "documents"), min_chars=10)
    return maps.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.concat(base, F.col("entropy"))).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_pages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", min_bytes=0)
    original = F.when(F.col("response.type") == "revisit", F.col("original.page_id").cast("long"))
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("original.payload_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        original.alias("refers_to"),
    )


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    text = restored(F.col("output"), F.col("form"))
    return stash(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256")), "fim")


# The rules of the contract, (verdict, host, beginning of the path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), base_of=100)


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_toxicity, op3_exact_dedup, op4_simhash, op5_line_dedup, op6_mixing, op7_topk, op8_secrets, op9_quality, op10_warc, op11_fim, op12_url_filter, op13_prefix_trie)
}
