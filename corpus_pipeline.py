"""From raw documents to tokens: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import bpe, decontaminate, jaccard, langid, suffix_dedup
from stratagraph.llm.common import cut, passing, table
from stratagraph.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; null texts and those without a letter go, a missing lang is filled in. Repeated rows fare alike."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each group that links of similarity 0.8 join; null ids come last, of wholly repeated rows one stays."""
    return jaccard.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that repeated strings of 200 bytes cover; a text with nothing left goes."""
    return suffix_dedup.strip_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of the benchmark; repeated rows fare alike, null texts would stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids), ids as little-endian 32-bit numbers; a null text has none, rows that repeat
    each have theirs, a null doc_id stays null."""
    return bpe.encode_documents(docs, tokenizer_path(), keep_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("contamination", contamination), ("tokens", tokens)]

#: No SQL says what the language model, the forest and the suffix arrays decide; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of `documents`, each written and read again. Null, empty and letterless texts go in the first stage; of equal
    and near texts the least doc_id stays (ties to the least hash of the text); empty tables give empty results; further columns
    pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing() as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
