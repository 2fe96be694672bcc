"""The registered queries of this subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    bpe,
    dart_minhash,
    decision_lists,
    hard_negatives,
    lz_fingerprint,
    mixing,
    packing,
    pii,
    quotes,
    token_store,
    warc,
    whitening,
    window_lm,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document, five-word shingles, similarity of 0.8 or more."""
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op3_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(ids, RANKS).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = packing.pack_documents(docs, VOCABULARY, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return decision_lists.judged(docs, labels, ["doc_id"]).select("doc_id", *decision_lists.COUNTS, "base_failed", "kept", "rule")


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_store.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_efraimidis_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "epochs", "place")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is one on, as the contract has it, and every hundredth row an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_dart_minhash, op2_quotation_links, op3_merge_replay, op4_pseudo_likelihood, op5_warc_index, op6_lz_fingerprint,
        op7_packing, op8_decision_lists, op9_simple8b, op10_bootstrapped_pii, op11_efraimidis_mixing, op12_whitening, op13_hilbert_negatives)
}
ORACLES: dict[str, str] = {"op11_efraimidis_mixing": mixing.ORACLE, "op13_hilbert_negatives": hard_negatives.ORACLE}
