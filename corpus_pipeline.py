"""From raw documents to packed token ids: rejects, near copies and leaks go, sources are mixed, ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermark.llm.decontamination import clean_documents
from lettermark.llm.jaccard import one_of_each
from lettermark.llm.mixing import mixed_documents
from lettermark.llm.quality import good_documents
from lettermark.llm.queries import table, tokenizer_path
from lettermark.llm.token_files import packed_tokens
from lettermark.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked 5-gram sets."""
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), percent=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, weights=(3, 1, 2), percent=150, most=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, with the place and checksum of each document."""
    return packed_tokens(docs, tokenizer_path(), end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("token ids", tokens),
]

# Learnt rules, edit distances and the tokenizer are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
