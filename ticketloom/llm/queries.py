"""One query for each operator over the supplied tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.llm import (
    collocations, decontaminate, fill_middle, language_id, mixing, neighbours, ngram_join, secret_scan, simhash, suffix_dedup, toxicity, warc,
    wavelet,
)
from ticketloom.llm.common import table
from ticketloom.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.Decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.report().select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.spans_digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wavelet.token_output(table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def op13_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_nearest, op3_mix_sources, op4_secret_spans, op5_warc_packages, op6_language,
        op7_simhash_components, op8_toxicity, op9_suffix_dedup, op10_token_shards, op11_collocations,
        op12_fill_in_middle, op13_ngram_components,
    )
}
