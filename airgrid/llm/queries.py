"""Registered queries ``opN_<name>`` of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import (align, chat, decontam, licenses, merkle, omh, packing, pieces, pii, tokens, toxicity, vectors,
                         warc)
from airgrid.llm.common import held_out, table
from airgrid.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out third of the ids."""
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                              lambda i: ~held_out(i))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label: links, component and the one that is kept."""
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base patterns (counts and digest) and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    counts = [pii.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document and the one that is kept."""
    return omh.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each token in the line of its first character."""
    return tokens.attribute(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark overlap of every document."""
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort("hit_items")
    return found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"),
                        F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        decontam.is_contaminated().alias("contaminated"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document."""
    return packing.pack_texts(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a content-addressed archive of ``pages``, written and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the licence whose text it is."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole document with the end id, and what they decode to."""
    return pieces.digests(table(spark, sf_dir, "documents"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of ``documents``: digests, proofs and the check of tampered rows."""
    found = merkle.manifest(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                         merkle.fold(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document, scored by corpus-wide link counts."""
    return align.align(table(spark, sf_dir, "documents"))
