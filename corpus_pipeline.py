"""From raw documents to token files: each stage is one of the training-data operators, written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recon.llm.common import Kept, read
from recon.llm.decontaminate import without_leaks
from recon.llm.language_id import keep_identified
from recon.llm.mixing import mixed_documents
from recon.llm.simhash_dedup import keep_one
from recon.llm.token_output import encoded_digest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be identified go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out so that each source has its target weight."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and from them ``doc_id, start, n_tokens, ids_crc32`` of each of its documents."""
    return encoded_digest(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_files", token_files)]

#: SQL cannot express the language models nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each over what the one before it kept."""
    docs, kept = read(spark, sf_dir, "documents"), Kept(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept.keep(docs)
    return docs
