"""Tables as files: readers with a declared schema, overwriting sinks with partitions and an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_IMPACT = ", ".join(f"impact_{k}year BIGINT" for k in range(1, 16))

#: Columns and types of the tables that steps exchange; sources first.
SCHEMAS = {
    "papers": "paper_id BIGINT, doi STRING, year INT, month INT, journal_id BIGINT, doc_type STRING, doc_sub_types STRING, reference_count INT, title STRING",
    "paper_references": "paper_id BIGINT, paper_reference_id BIGINT",
    "aps_citations": "citing_doi STRING, cited_doi STRING",
    "journals": "journal_id BIGINT, paper_count BIGINT",
    "paper_fields_of_study": "paper_id BIGINT, field_id BIGINT, score DOUBLE",
    "fields_of_study": "field_id BIGINT, level INT, name STRING",
    "field_hierarchy": "child_field_id BIGINT, field_id BIGINT",
    "authorships": "paper_id BIGINT, author_id BIGINT, affiliation_id BIGINT, seq INT",
    "letter_links": "original_doi STRING, letter_doi STRING, venue STRING",
    "rankings": "university STRING, field STRING, frac_counting INT, period STRING, impact_p DOUBLE, pp_top5 DOUBLE",
    "elite": "university STRING, grid_id STRING, year INT, rank INT",
    "letter_metadata": "original_id BIGINT, letter_id BIGINT, original_year INT, letter_year INT, retracted INT, venue STRING",
    "paper_impact": f"id BIGINT, year INT, month INT, reference_count BIGINT, venue STRING, {_IMPACT}",
    "agg_letters": f"original_id BIGINT, letter_id BIGINT, original_year INT, letter_year INT, venue STRING, lag INT, id BIGINT, month INT, reference_count BIGINT, {_IMPACT}, num_critical_letters BIGINT",
    "agg_nonletters": f"id BIGINT, year INT, month INT, reference_count BIGINT, venue STRING, {_IMPACT}",
    "career_histories": "author_id BIGINT, paper_id BIGINT, year INT, author_position STRING, num_authors INT, impact_3year_norm DOUBLE, field BIGINT",
}
#: How NULL is written in text files, so that it differs from the empty string; a text of just this reads as NULL.
NULL_TEXT = "\\N"


def read_table(spark: SparkSession, path: str, table: str | StructType, format: str = "csv") -> DataFrame:
    """A table by its declared schema (a name in SCHEMAS, a schema text or type), without a pass to infer types.

    Text files have a header that must name the columns of the file in order, with the partition columns in the folder
    names; a row that does not fit the schema stops the job. The columns come back in the order declared.
    """
    schema = SCHEMAS.get(table, table) if isinstance(table, str) else table
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.options(header=True, enforceSchema=False, mode="FAILFAST", nullValue=NULL_TEXT, emptyValue="", escape='"', multiLine=True)
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return reader.format(format).load(path).select(*[f"`{c}`" for c in declared.names])


def write_table(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), order_by: tuple[str, ...] = (), format: str = "csv",
    rows_per_file: int = 0,
) -> None:
    """Write a frame, replacing what is at `path`, as compressed files (gzip text, or zstd in other formats).

    `order_by` sorts globally: rows are range-partitioned by the partition columns and the order, so the files of a
    partition, by name, follow it and one hot partition is written by several tasks. `rows_per_file` splits a task's
    output into more shards. An empty frame leaves an empty table.
    """
    order = [*partition_by, *order_by]
    if order_by:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").format(format).option("maxRecordsPerFile", rows_per_file)
    if format == "csv":
        writer = writer.options(header=True, compression="gzip", nullValue=NULL_TEXT, escape='"')
    else:
        writer = writer.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
