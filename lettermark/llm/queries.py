"""Queries over the test tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermark.llm.codes import vector_codes
from lettermark.llm.decontamination import leaks
from lettermark.llm.embeddings import near_vectors
from lettermark.llm.fim import fill_in_middle, store_frames, with_digests
from lettermark.llm.jaccard import ngram_components
from lettermark.llm.licenses import license_scan
from lettermark.llm.line_dedup import dedup_lines
from lettermark.llm.mixing import fair_mix
from lettermark.llm.pii import personal_data
from lettermark.llm.quality import STATISTICS, score_quality, text_statistics
from lettermark.llm.sql import SQL  # noqa: F401
from lettermark.llm.suffixes import cut_repeats
from lettermark.llm.token_files import packed_tokens
from lettermark.llm.warc import archive_pages
from lettermark.session import cut_lineage


#: Rows of an Arrow batch, where the session does not set them: long texts then take little memory of a worker.
BATCH_ROWS = 2_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":  # Spark's own value
        spark.conf.set(setting, BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents"), width=3)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages"), least_bytes=0).drop("url")


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=5)


def op4_packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return packed_tokens(table(spark, folder, "documents"), tokenizer_path(), end_id=0)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = cut_lineage(text_statistics(table(spark, folder, "documents"), "doc_id"))
    return score_quality(measured, table(spark, folder, "labels")).drop(*STATISTICS)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"), percent=80)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"), least=0.9)


def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return fair_mix(table(spark, folder, "documents"), weights=(3, 1, 2), percent=150, most=2).drop("copies", "row_key")


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), cosine=0.93, tables=8, probes=4, hashes=3)


def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"), words=3, percent=90)


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return with_digests(fill_in_middle(store_frames(table(spark, folder, "documents")), rate=90, spm=20, seed="1"))


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = cut_repeats(table(spark, folder, "documents"), length=100)
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(table(spark, folder, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_warc, op3_benchmark_decontamination, op4_packed_tokens, op5_quality_rules, op6_license_scan, op7_pii,
        op8_source_mix, op9_embedding_dedup, op10_ngram_jaccard, op11_fill_in_middle, op12_suffix_dedup, op13_vector_codes,
    )
}

