"""One query per operator over the supplied tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from agora.llm import bpe, curriculum, divergence, html_content, licenses, ngram_join, prefix_trie, repetition, secret_scan, simhash, token_files, toxicity, vafile
from agora.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

#: A document is called toxic from this score on.
TOXIC = 0.3

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition features and verdict of every document."""
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licence of every document, as a tree of files."""
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents")))


def op3_vector_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to Arrow files and read back."""
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, base spans as a digest."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])],
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op9_html_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_content.extract(pages, html_content.fit(pages))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = curriculum.schedule(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every document."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' prefix trie."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources, and terms of each source, by divergence."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_license_scan": op2_license_scan,
    "op3_vector_file_search": op3_vector_file_search,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_marginals": op9_html_marginals,
    "op10_curriculum_mix": op10_curriculum_mix,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_divergence": op13_source_divergence,
}

#: Where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.SCAN_SQL,
    "op3_vector_file_search": vafile.TOP_K_SQL,
    "op10_curriculum_mix": curriculum.SCHEDULE_SQL,
    "op12_conversation_trie": prefix_trie.TRIE_SQL,
    "op13_source_divergence": divergence.AUDIT_SQL,
}
