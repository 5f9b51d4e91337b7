"""Research fields of papers, of what they cite and of what cites them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.functions.binning import equal_width_bin
from lettermark.functions.keys import lookup, null_safe_join
from lettermark.operators.graph import target_papers
from lettermark.session import cut_lineage


def paper_fields(
    pfos: DataFrame, fos: DataFrame, papers: DataFrame, venues: dict[str, int], start_year: int = 2000
) -> DataFrame:
    """Fields of level 0 or 1 with a positive score for the target papers."""
    target = target_papers(papers, venues, start_year).select("paper_id")
    levels = fos.filter(F.col("level").isin(0, 1)).select("field_id", "level")
    return (
        pfos.filter(F.col("score") > 0)
        .join(target, "paper_id")
        .join(levels, "field_id")
        .select(F.col("paper_id").alias("id"), F.col("field_id").alias("field"), "level")
    )


def rollup_fields(fields: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Add the parent field, or the field itself when it has none; several parents give several rows."""
    parents = hierarchy.select(F.col("child_field_id").alias("field"), F.col("field_id").alias("_parent"))
    return fields.join(parents, "field", "left").select(
        "id", "field", "level", F.coalesce("_parent", "field").alias("field_level0")
    )


def _level0(pfos: DataFrame, hierarchy: DataFrame, fos: DataFrame) -> DataFrame:
    """(paper_id, field) at level 0 for every scored field, one row per source row and parent."""
    parents = hierarchy.select(F.col("child_field_id").alias("field_id"), F.col("field_id").alias("_parent"))
    top = fos.filter(F.col("level") == 0).select(F.col("field_id").alias("field"), F.col("name").alias("field_name"))
    return (
        pfos.filter(F.col("score") > 0)
        .join(parents, "field_id", "left")
        .select("paper_id", F.coalesce("_parent", "field_id").alias("field"))
        .join(top, "field")
    )


def reference_fields(
    edges: DataFrame, papers: DataFrame, pfos: DataFrame, hierarchy: DataFrame, fos: DataFrame,
    venues: dict[str, int], start_year: int = 2000,
) -> DataFrame:
    """Level-0 fields of everything the target papers cite, duplicates kept."""
    target = target_papers(papers, venues, start_year).select("paper_id")
    refs = cut_lineage(edges.select("paper_id", "paper_reference_id").join(target, "paper_id"))
    cited = refs.select(F.col("paper_reference_id").alias("paper_id")).distinct()
    tags = _level0(pfos.join(cited, "paper_id", "left_semi"), hierarchy, fos).select(F.col("paper_id").alias("paper_reference_id"), "field")
    return refs.join(tags, "paper_reference_id").select("paper_id", "paper_reference_id", "field")


def citation_fields(
    edges: DataFrame, papers: DataFrame, pfos: DataFrame, hierarchy: DataFrame, fos: DataFrame,
    venues: dict[str, int], start_year: int = 2000, horizon: int = 5,
) -> DataFrame:
    """Level-0 fields of the papers citing a target paper up to `horizon` years later, each once."""
    target = target_papers(papers, venues, start_year).select(
        F.col("paper_id").alias("cited_paper_id"), F.col("year").alias("_cited_year")
    )
    citing = papers.select(F.col("paper_id").alias("citing_paper_id"), F.col("year").alias("_citing_year"))
    cites = (
        edges.select(F.col("paper_reference_id").alias("cited_paper_id"), F.col("paper_id").alias("citing_paper_id"))
        .join(target, "cited_paper_id")
        .join(citing, "citing_paper_id")
        .filter(F.col("_citing_year") - F.col("_cited_year") <= horizon)
    )
    cites = cut_lineage(cites.select("cited_paper_id", "citing_paper_id").distinct())
    known = cites.select(F.col("citing_paper_id").alias("paper_id")).distinct()
    tags = _level0(pfos.join(known, "paper_id", "left_semi"), hierarchy, fos).select(F.col("paper_id").alias("citing_paper_id"), "field").distinct()
    return cites.join(tags, "citing_paper_id").select("cited_paper_id", "citing_paper_id", "field")


def simpson_diversity(
    pairs: DataFrame, paper: str, other: str, min_distinct: int = 10, strict: bool = False, out: str = "simpson"
) -> DataFrame:
    """Minus the sum of squared field shares, for papers with enough distinct neighbours."""
    pairs = cut_lineage(pairs.select(paper, other, "field"))  # read for the gate and for the shares
    distinct = F.count_distinct(other)
    gate = pairs.groupBy(F.col(paper).alias("id")).agg(distinct.alias("_n")).filter(
        F.col("_n") > min_distinct if strict else F.col("_n") >= min_distinct
    )
    shares = pairs.groupBy(F.col(paper).alias("id"), "field").agg(F.count(F.lit(1)).alias("_c"))
    scores = shares.groupBy("id").agg(
        (-F.sum(F.col("_c") * F.col("_c")) / (F.sum("_c") * F.sum("_c"))).alias(out)
    )
    return scores.join(gate.select("id"), "id")


def field_cells(fields: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort rows once per distinct top-level field."""
    return (
        fields.select("id", F.col("field_level0").alias("field"))
        .distinct()
        .join(cohort, "id")
    )


def field_representation(
    fields: DataFrame, cohort: DataFrame, names: dict[int, str], min_count: int = 10
) -> DataFrame:
    """Share of a field among targeted papers over its share among the others, per venue."""
    counts = (
        field_cells(fields, cohort)
        .groupBy("venue", lookup(F.col("field"), names).alias("field"))
        .agg(
            F.count_if(F.col("type") == "letter").alias("n_letter"),
            F.count_if(F.col("type") == "article").alias("n_article"),
        )
    )
    totals = counts.groupBy("venue").agg(F.sum("n_letter").alias("t_letter"), F.sum("n_article").alias("t_article"))
    targeted = F.col("n_letter") / F.col("t_letter")
    baseline = F.when(F.col("n_article") > 0, F.col("n_article") / F.col("t_article")).otherwise(targeted)
    return (
        counts.filter(F.col("n_letter") > min_count)
        .join(totals, "venue")
        .select("venue", "field", F.col("n_letter").alias("count"), (targeted / baseline).alias("ratio"))
        .withColumn("ratio_sign", F.col("ratio") > 1)
    )


def dominant_field(pfos: DataFrame, hierarchy: DataFrame, fos: DataFrame) -> DataFrame:
    """Most frequent level-0 field of every paper; the smaller id wins a tie."""
    counted = (
        _level0(pfos, hierarchy, fos)
        .groupBy("paper_id", "field", "field_name")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("k"), F.col("field"), F.col("field_name"))).alias("_b")
    return counted.groupBy("paper_id").agg(best).select("paper_id", "_b.field", "_b.field_name")


def forward_citations(refs: DataFrame, papers: DataFrame, span: int = 3, start_year: int = 1980) -> DataFrame:
    """Journal citations received in the publication year and the `span` years after it."""
    journal = papers.filter((F.col("doc_type") == "Journal") & F.col("year").isNotNull())
    citing = journal.select("paper_id", F.col("year").alias("citing_year"))
    per_year = (
        refs.join(citing, "paper_id")
        .groupBy("paper_reference_id", "citing_year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cited = journal.filter(F.col("year") >= start_year).select(
        F.col("paper_id").alias("paper_reference_id"), "year"
    )
    return (
        per_year.join(cited, "paper_reference_id")
        .filter(F.col("citing_year").between(F.col("year"), F.col("year") + span))
        .groupBy(F.col("paper_reference_id").alias("paper_id"), "year")
        .agg(F.sum("n").alias("impact_3year"))
    )


def field_normalised_impact(
    refs: DataFrame, papers: DataFrame, pfos: DataFrame, fos: DataFrame, start_year: int = 1980
) -> DataFrame:
    """Three-year citations over the mean of each (level-1 field, year), averaged across the paper's fields."""
    cited = forward_citations(refs, papers, 3, start_year)
    level1 = fos.filter(F.col("level") == 1).select("field_id")
    tagged = pfos.join(level1, "field_id").join(cited, "paper_id")
    means = tagged.filter(F.col("score") > 0).groupBy("field_id", "year").agg(F.avg("impact_3year").alias("_mean"))
    return (
        tagged.join(means, ["field_id", "year"])
        .groupBy("paper_id")
        .agg(F.avg(F.col("impact_3year") / F.col("_mean")).alias("impact_3year_norm"))
    )


def cell_normalised_impact(fields: DataFrame, cohort: DataFrame, bins: int = 6) -> DataFrame:
    """Raw and cell-relative two-year impact of a paper; a cell is venue, period and level-1 field."""
    rows = fields.filter(F.col("level") == 1).select("id", "field").join(cohort, "id")
    rows = equal_width_bin(rows, "year", bins, "period")
    cells = rows.groupBy("venue", "period", "field").agg(F.avg("impact_2year").alias("_mean"))
    return (
        null_safe_join(rows, cells, ["venue", "period", "field"], "inner")
        .groupBy("id", "venue", "period", "year", "type")
        .agg(
            F.avg("impact_2year").alias("raw_impact"),
            F.avg(F.try_divide(F.col("impact_2year"), F.col("_mean"))).alias("norm_impact"),
        )
        .filter(F.col("raw_impact") > 0)
    )
