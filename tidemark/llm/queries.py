"""One query per training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import languages, oracle, ordinal
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.embeddings import near_vectors
from tidemark.llm.filter_audit import interactions
from tidemark.llm.html_text import extract
from tidemark.llm.lexicon import encode_texts
from tidemark.llm.manifest import document_leaves, manifest
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.substrings import repeated_words
from tidemark.llm.token_blocks import token_store


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = ordinal.fit(docs, ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), top=2)
    return ordinal.rate(docs, model)


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    found = languages.identify(docs, languages.fit(docs))
    held_out = F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "cross_entropy", "rejected")


def op3_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_store(_docs(spark, sf_dir).select("doc_id", "text"), with_ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir).select("doc_id", "text"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir).select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(_docs(spark, sf_dir).select("doc_id", "text"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir).select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(_docs(spark, sf_dir).select("doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    return manifest(document_leaves(_docs(spark, sf_dir), F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), lowered))).drop("n_steps")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL = {"op4_rotation_codes": oracle.OP4, "op9_substring_dedup": oracle.OP9, "op11_filter_audit": oracle.OP11, "op12_winnowing": oracle.OP12, "op13_merkle_manifest": oracle.OP13}


def oracle_sql() -> dict[str, str]:
    """Of these only :data:`SQL`; ``tests/llm`` holds the others against a brute-force version, a round trip or held-out accuracy."""
    return dict(SQL)
