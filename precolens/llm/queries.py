"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precolens.llm import alignment, bpe, classifier, knn, lexical, lm, packing, quality, repeats, sharding, simhash, token_counts, warc
from precolens.llm.common import table

SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees).select(
        "doc_id", *(f"quality_rules.{c}" for c in (*quality.COUNTS, "base_failed", "kept"))
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.vectors(table(spark, sf_dir, "embeddings"))
    return knn.top_k(rows.where("id % 100 = 0"), rows).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.digests(bpe.decode(ids, ranks))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(docs, path, public_tokenizers.PATTERN).select("doc_id", "tokens.*")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select(
        "doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256")
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    vectors = classifier.word_vectors(docs)
    network = classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out), vectors)
    scored = classifier.score(docs, network, vectors, out="score")
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_lm": op4_lm,
    "op5_topk": op5_topk,
    "op6_repeats": op6_repeats,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_lexical": op12_lexical,
    "op13_classifier": op13_classifier,
}
