"""The corpus pipeline: each stage writes Parquet, which the next one reads as its documents.

Counted as part of the subpackage llm. Every stage works on all rows that its predecessor kept, and keeps all columns of
documents, whatever others there are. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from hypsoline.llm import bpe, langid, mixing, nearcopies, pii, simhash
from hypsoline.llm.common import shared_dir, table
from hypsoline.llm.queries import PIECES, RANKS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the learned model rejects go: those without a letter (null and empty texts among them), and
    those whose letters no learned language explains. Repeated rows share their fate; a null lang is no reason to go."""
    return langid.keep_known(docs, PIECES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id stays; of
    rows that repeat an id, the one with the smallest hash, once. Rows with a null id stay. Null and wordless texts are
    copies of each other."""
    return simhash.keep_one(docs, nearcopies.near_copies(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found personal data gives way to its kind in brackets; n_chars follows the new text. Null texts stay null; repeated
    rows stay and agree."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes as often as its target weight asks; a document comes up to three times, in the shards that the
    splitting tree dealt its blocks to. The null source is one source; null texts have no words and come as their block
    does; repeated rows share their fate, so each comes as often as the other."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether decoding them gives back the text's bytes. Null and empty texts have no ids;
    repeated rows agree."""
    return bpe.checked(docs, RANKS, tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: The model-based stages can't be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage writes lies in the application's shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
