"""Criticised papers, their comparison pool, and tables keyed to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.config import OTHER_APS, VENUE_LEVELS, VENUE_LEVELS_ALL
from lettermark.operators.graph import target_papers, venue_of


def resolve_links(links: DataFrame, papers: DataFrame) -> DataFrame:
    """DOI pairs to paper ids and years. A missing sub-type counts as retracted, like a non-empty one."""
    known = papers.filter(F.col("doi").isNotNull())
    orig = known.select(
        F.col("doi").alias("original_doi"),
        F.col("paper_id").alias("original_id"),
        F.col("year").alias("original_year"),
        F.col("doc_sub_types").alias("_sub"),
    )
    lett = known.select(
        F.col("doi").alias("letter_doi"), F.col("paper_id").alias("letter_id"), F.col("year").alias("letter_year")
    )
    return (
        links.join(orig, "original_doi", "left")
        .join(lett, "letter_doi", "left")
        .select(
            "original_id",
            "letter_id",
            "original_year",
            "letter_year",
            F.when(F.col("_sub") == "", 0).otherwise(1).alias("retracted"),
            "venue",
        )
    )


def treated_cohort(
    letters: DataFrame, impact: DataFrame, min_refs: int = 5, start_year: int = 2000, end_year: int = 2020
) -> DataFrame:
    """One row per criticised paper: its earliest letter, the letter count and its impact columns."""
    first = F.struct(
        F.col("letter_year").isNull(), F.col("letter_year"), F.col("letter_id").isNull(), F.col("letter_id")
    )
    per_paper = (
        letters.filter(
            (F.col("original_year") >= start_year) & (F.col("original_year") < end_year) & (F.col("retracted") != 1)
        )
        .groupBy("original_id", "original_year", "venue")
        .agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("num_critical_letters"))
        .select(
            "original_id",
            F.col("_first.letter_id").alias("letter_id"),
            "original_year",
            F.col("_first.letter_year").alias("letter_year"),
            "venue",
            (F.col("_first.letter_year") - F.col("original_year")).alias("lag"),
            "num_critical_letters",
        )
    )
    scores = impact.drop("year").filter(F.col("reference_count") >= min_refs)
    horizons = [c for c in impact.columns if c.startswith("impact_")]
    return per_paper.join(
        scores, (per_paper.original_id == scores.id) & (per_paper.venue == scores.venue)
    ).select(
        "original_id", "letter_id", "original_year", "letter_year", per_paper.venue, "lag", "id", "month",
        "reference_count", *horizons, "num_critical_letters",
    )


def control_cohort(
    impact: DataFrame, letters: DataFrame, min_refs: int = 5, start_year: int = 2000, end_year: int = 2020
) -> DataFrame:
    """Papers of the same years that neither received nor are a letter, judged on the unfiltered links."""
    linked = (
        letters.select("venue", F.explode(F.array("original_id", "letter_id")).alias("id"))
        .filter(F.col("id").isNotNull())
        .distinct()
    )
    return impact.filter(
        (F.col("year") >= start_year) & (F.col("year") < end_year) & (F.col("reference_count") >= min_refs)
    ).join(linked, ["id", "venue"], "left_anti").select(impact.columns)


def stack_cohorts(letters: DataFrame, nonletters: DataFrame) -> DataFrame:
    """Both groups under one schema; a venue outside the known levels becomes NULL."""
    metrics = [f"impact_{k}year" for k in (2, 3, 4)]
    treated = letters.select(
        F.col("id"), F.col("original_year").alias("year"), "venue", *metrics, "lag", F.lit("letter").alias("type")
    )
    pool = nonletters.select("id", "year", "venue", *metrics, F.lit("article").alias("type"))
    return treated.unionByName(pool, allowMissingColumns=True).withColumn(
        "venue", F.when(F.col("venue").isin(*VENUE_LEVELS_ALL), F.col("venue"))
    )


def collapse_venues(df: DataFrame) -> DataFrame:
    """Fold the society sections into one venue and drop venues outside the display set."""
    folded = F.when(F.col("venue").isin(*OTHER_APS), F.lit("Other APS")).otherwise(F.col("venue"))
    return df.withColumn("venue", folded).filter(F.col("venue").isin(*VENUE_LEVELS))


def gather(*frames: DataFrame) -> DataFrame:
    """Concatenate parts by column name; a column missing from a part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cohort_counts(df: DataFrame) -> DataFrame:
    """Papers per venue, one column per group."""
    return (
        df.filter(F.col("venue").isNotNull())
        .groupBy("venue")
        .agg(
            F.count_if(F.col("type") == "article").alias("articles"),
            F.count_if(F.col("type") == "letter").alias("critical_letters"),
        )
    )


def stance_counts(papers: DataFrame, stance: DataFrame, venues: dict[str, int], start_year: int = 2000) -> DataFrame:
    """Citation stance counts of the target papers, matched on DOI in any letter case."""
    target = target_papers(papers, venues, start_year).select(
        "paper_id", F.lower("doi").alias("_doi"), venue_of(venues).alias("venue")
    )
    return stance.join(target, F.lower(stance.doi) == target["_doi"]).select(
        "paper_id",
        stance.doi.alias("cited_doi"),
        "contrasting_received",
        "supporting_received",
        "mentioning_received",
        "venue",
    )


def attention_features(features: DataFrame, venues: dict[str, int], start_year: int = 2000) -> DataFrame:
    """Attention columns of the journal articles in the venues, team size as an integer."""
    return features.filter(
        F.col("journal_id").isin(list(venues.values()))
        & (F.col("year") >= start_year)
        & (F.col("doc_type") == "Journal")
    ).select(
        "id", "doi", "atyp_10pct_z", "tweet_count", "newsfeed_count", F.round("team_size").cast("bigint").alias("team_size")
    )
