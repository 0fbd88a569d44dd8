"""Registered queries of the operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    languages, logp = train(docs.where(~held_out))
    return identify(docs, languages, logp, carry={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score", "n_languages")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.piece_codec import encode_pieces

    return encode_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), keep_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.bpe_lexicon import bpe_words

    return bpe_words(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_language_id, op3_token_files, op4_decontaminate, op5_warc, op6_sentencepiece, op7_quality, op8_html_text, op9_substring_dedup, op10_quality_rules, op11_filter_audit, op12_importance, op13_bpe_lexicon)}
