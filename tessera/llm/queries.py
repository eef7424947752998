"""The operators' queries over the given tables: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    ann,
    bpe,
    contamination,
    embed_dedup,
    language_id,
    lm_score,
    minhash,
    mixing,
    prefix_trie,
    quality,
    sharding,
    token_counts,
)
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.98 or more."""
    return embed_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"), 0.98)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.read_tokenizer(tokenizer_path("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return token_counts.count_tokens(table(spark, sf_dir, "documents"), f.read())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 in turn over the sources."""
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; hosts are their sources, paths the languages within."""
    docs = table(spark, sf_dir, "documents")
    evidence = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(spark, docs.select("doc_id", "text", "source", "lang"), evidence, F.col("source"), F.col("lang"))
    return out.select("doc_id", "host", "path", "log_factor", "site_rate", "quality", (F.col("quality") >= 0.5).alias("kept"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector with an id divisible by 50 among all others."""
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score under the counts of all others."""
    return lm_score.score_documents(spark, table(spark, sf_dir, "documents"))


def op8_lm_scores_order_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with contexts of up to two words."""
    return lm_score.score_documents(spark, table(spark, sf_dir, "documents"), order=3)


def op9_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = sharding.shard(spark, table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 85 % or more of common 3-word shingles."""
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), 3, 85)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in runs of 10 words of a benchmark item."""
    return contamination.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix that rebuilt conversations have, with its members and what sharing it saves."""
    return prefix_trie.shared_prefixes(spark, table(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's links between the tokens of two tokenizers, with corpus-wide counts."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return alignment.align(spark, table(spark, sf_dir, "documents"), bpe.read_tokenizer(tokenizer_path("byte_bpe_50k.json")), model)


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_embedding_near_dedup": (op2_embedding_near_dedup, None),
    "op3_bpe_round_trip": (op3_bpe_round_trip, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_source_mixing": (op5_source_mixing, mixing.SQL),
    "op6_quality": (op6_quality, None),
    "op7_nearest_neighbours": (op7_nearest_neighbours, None),
    "op8_lm_scores": (op8_lm_scores, lm_score.SQL),
    "op8_lm_scores_order_3": (op8_lm_scores_order_3, lm_score.SQL_ORDER_3),
    "op9_consistent_sharding": (op9_consistent_sharding, None),
    "op10_near_dedup": (op10_near_dedup, None),
    "op11_benchmark_decontamination": (op11_benchmark_decontamination, contamination.SQL),
    "op12_conversation_prefix_trie": (op12_conversation_prefix_trie, prefix_trie.SQL),
    "op13_tokenizer_alignment": (op13_tokenizer_alignment, None),
}
