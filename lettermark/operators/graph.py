"""Citation edges and the counts taken straight from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def venue_of(venues: dict[str, int], journal: str = "journal_id") -> Column:
    """Venue name of a journal id; NULL outside the configured set."""
    expr = F.lit(None).cast("string")
    for name, journal_id in venues.items():
        expr = F.when(F.col(journal) == journal_id, name).otherwise(expr)
    return expr


def target_papers(papers: DataFrame, venues: dict[str, int], start_year: int | None, end_year: int | None = None) -> DataFrame:
    """Journal articles without a sub-type in the configured venues."""
    out = papers.filter(
        F.col("journal_id").isin(list(venues.values()))
        & (F.col("doc_type") == "Journal")
        & (F.col("doc_sub_types") == "")
    )
    if start_year is not None:
        out = out.filter(F.col("year") >= start_year)
    if end_year is not None:
        out = out.filter(F.col("year") <= end_year)
    return out


def union_refs(refs: DataFrame, aps: DataFrame, papers: DataFrame) -> DataFrame:
    """Native edges plus the edges given as DOI pairs, each once. An unknown DOI leaves a NULL id."""
    ids = papers.filter(F.col("doi").isNotNull()).select("doi", "paper_id")
    pairs = aps.select(F.upper("citing_doi").alias("citing_doi"), F.upper("cited_doi").alias("cited_doi")).distinct()
    citing = ids.select(F.col("doi").alias("citing_doi"), "paper_id")
    cited = ids.select(F.col("doi").alias("cited_doi"), F.col("paper_id").alias("paper_reference_id"))
    extra = pairs.join(citing, "citing_doi", "left").join(cited, "cited_doi", "left")
    return (
        refs.select("paper_id", "paper_reference_id")
        .unionByName(extra.select("paper_id", "paper_reference_id"))
        .distinct()
    )


def reference_counts(edges: DataFrame) -> DataFrame:
    """Known references per citing paper; papers without any edge do not appear."""
    return (
        edges.filter(F.col("paper_id").isNotNull())
        .groupBy("paper_id")
        .agg(F.count("paper_reference_id").alias("reference_count"))
    )


def windowed_impact(
    edges: DataFrame,
    papers: DataFrame,
    venues: dict[str, int],
    horizons: Iterable[int] = range(1, 16),
    start_year: int = 2000,
    min_lag: int | None = None,
) -> DataFrame:
    """Citations a paper received within k years, for every k, in one pass.

    Citations are first counted per (cited paper, citing year), so a paper cited by a large share of all
    edges reaches the second join as a handful of rows. There is no lower bound on the lag unless `min_lag`
    is given.
    """
    citing = papers.filter(F.col("doc_type") == "Journal").select("paper_id", F.col("year").alias("citing_year"))
    per_year = (
        edges.join(citing, "paper_id")
        .groupBy(F.col("paper_reference_id").alias("id"), "citing_year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cited = target_papers(papers, venues, start_year).select(
        F.col("paper_id").alias("id"), "year", "month", venue_of(venues).alias("venue")
    )
    lag = F.col("citing_year") - F.col("year")
    inside = lambda k: (lag <= k) if min_lag is None else lag.between(min_lag, k)
    impact = (
        per_year.join(cited, "id")
        .groupBy("id", "year", "month", "venue")
        .agg(*[F.sum(F.when(inside(k), F.col("n")).otherwise(0)).alias(f"impact_{k}year") for k in horizons])
    )
    counts = reference_counts(edges).withColumnRenamed("paper_id", "id")
    return impact.join(counts, "id", "left").select(
        "id", "year", "month", "reference_count", "venue", *[f"impact_{k}year" for k in horizons]
    )
