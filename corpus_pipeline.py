"""The corpus pipeline: from raw documents to the token ids of a mixed, clean corpus.

Each stage is a function of (session, documents, input folder) and works on all that the stage
before kept; its result is written as Parquet and read again as the next one's documents. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language_id, minhash, mixing, quality
from tessera.llm.common import drop_table, table
from tessera.llm.queries import tokenizer_path
from tessera.session import ensure_checkpoint_dir, scratch_path

TOKENIZER = "word_bpe_49k.json"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters or with no clear language go."""
    ensure_checkpoint_dir(spark)
    learned = docs.where(~language_id.held_out(F.col("doc_id")))
    net = language_id.train(learned, noise=True)
    return language_id.keep_identified(docs, net, language_id.least_score(learned, net))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than not, by their own text and their site's."""
    ensure_checkpoint_dir(spark)
    evidence = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(spark, docs, evidence, F.col("source"), F.col("lang"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    ensure_checkpoint_dir(spark)
    return minhash.one_of_each(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: repeated documents are repeated rows, a cut one is cut."""
    ensure_checkpoint_dir(spark)
    return mixing.mixed_documents(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text that they decode to."""
    ensure_checkpoint_dir(spark)
    return bpe.encode(docs, bpe.read_tokenizer(tokenizer_path(TOKENIZER)), with_ids=True)


STAGES = [
    ("language ID", identified),
    ("quality classifier", good),
    ("MinHash near-dedup", unique),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: Trained models and hashed signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one's is written."""
    ensure_checkpoint_dir(spark)
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = scratch_path(spark, f"pipeline-{k}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(out)
        if path:
            drop_table(spark, path)
        docs, path = spark.read.schema(made.schema).parquet(out), out
    return docs
