"""A corpus pipeline of five stages, each a DataFrame of the columns of ``documents`` but the last.

quality classifier -> near-duplicate removal -> removal of repeated passages -> benchmark decontamination
-> piece ids. ``run`` writes each stage as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.decontaminate import decontaminate
from heddle.llm.near_dedup import drop_near_duplicates
from heddle.llm.piece_codec import encode_pieces
from heddle.llm.quality import fit_quality, score_quality
from heddle.llm.substring_dedup import dedup_substrings
from heddle.llm.textcore import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, documents=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (sets of five words, similarity of 0.8 or more)."""
    return drop_near_duplicates(docs, shingle=5, similarity=Fraction(4, 5))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand more than once; n_chars is counted again."""
    return dedup_substrings(docs, documents=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents=True)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, each compared with the other library."""
    import public_tokenizers

    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "parity", "token_ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("pieces", pieces)]

#: Stages 1, 2 and 5 learn from samples, sign with hash functions and run a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
