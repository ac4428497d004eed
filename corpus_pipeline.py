"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the documents that its predecessor kept; run() writes
each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, language_id, line_dedup, near_dedup, scratch, sentence_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest profile is no nearer than the others, or without a letter, go.

    Profiles come from this stage's labelled rows.  A score of 0 is chance: no profile tells the text from the others.
    """
    profiles = language_id.fit(docs)
    return language_id.predict(docs.select(COLUMNS), profiles).filter("lang_pred <> 'und' and score > 0").select(COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length that many sites share leave all documents but the first; a document of which nothing remains goes."""
    cut = line_dedup.dedup_lines(docs.select(COLUMNS), min_words=1)
    cut = cut.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: five-word shingles, similarity 0.8."""
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id")
    return scratch.without(docs.select(COLUMNS), gone, "duplicates")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    leaks = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scratch.without(docs.select(COLUMNS), leaks, "leaks")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces counted, digested and decoded again."""
    import public_tokenizers

    return sentence_pieces.encoded(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("sentence_pieces", encode_pieces),
]

#: SQL can't express the rank-order profiles, MinHash components and BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return docs
