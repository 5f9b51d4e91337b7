"""Chains of operators over one data folder; every step is built once and stays lazy."""

from __future__ import annotations

import uuid
from functools import cached_property as step

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.config import Config, FIELD_NAMES, NEWS_BREAKS, NEWS_LABELS, TWEET_BREAKS, TWEET_LABELS
from lettermark.functions.keys import rounded
from lettermark.operators import (
    attention, authors, cohorts, fields, graph, linkage, matching, models, novelty, ranking, reports, similarity,
    statistics, trajectories,
)
from lettermark.plans.run import run_cohorts
from lettermark.session import cut_lineage, shared_folder
from lettermark.sources.adapters import VENUES, Frames
from lettermark.sources.tables import read_table, write_table

START, END = 1995, 2002

# Parameters of the matching runs; tolerances in standard deviations. The wide ones are for the sparse test tables.
DELAYS = (3, 5)
PAPER_GRID = [{"impact_norm": i, "year": y} for i in (0.05, 0.1, 0.5) for y in (2.0, 3.0)]
AUTHOR_GRID = [{"impact_norm": i, "prod_norm": p, "lead_prod_norm": 0.4} for i in (0.05, 0.1, 0.5) for p in (0.1, 0.5)]
# The cell of each grid that the comparisons of impact and of careers read.
PAPER_CELL, AUTHOR_CELL = PAPER_GRID[4], AUTHOR_GRID[5]


def at_cell(df: DataFrame, cell: dict[str, float]) -> DataFrame:
    for c, tolerance in cell.items():
        df = df.filter(F.col(f"tol_{c}") == tolerance)
    return df


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Round result columns so that two engines print the same digits."""
    return df.select(*[rounded(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def score_kind(df: DataFrame, column: str) -> DataFrame:
    """Finite scores as rounded numbers; infinite and undefined ones as a word beside a NULL."""
    x = F.col(column)
    kind = (
        F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("finite")
    )
    return df.withColumn(f"{column}_kind", kind).withColumn(
        column, F.when(F.col(f"{column}_kind") == "finite", rounded(x))
    )


class Workbench(Frames):
    # graph and cohorts
    @step
    def edges(self):
        return graph.union_refs(self.refs, self.aps, self.papers)

    @step
    def impact(self):
        return graph.windowed_impact(self.edges, self.papers, VENUES, start_year=START)

    @step
    def impact_table(self):
        return cut_lineage(self.impact)

    @step
    def letters(self):
        return cohorts.resolve_links(self.links, self.papers)

    @step
    def treated(self):
        return cohorts.treated_cohort(self.letters, self.impact_table, 5, START, END)

    @step
    def controls(self):
        return cohorts.control_cohort(self.impact_table, self.letters, 5, START, END)

    @step
    def stacked(self):
        return cohorts.stack_cohorts(self.treated, self.controls)

    @step
    def cohort(self):
        return cohorts.collapse_venues(self.stacked)

    @step
    def gathered(self):
        return cohorts.gather(
            *[self.stacked_table.filter(F.col("venue") == v) for v in ("Nature", "Science", "PNAS", "PRL", "PR-B")],
            self.stacked_table.filter(F.col("venue").isNull()),
        )

    # files: what a sink wrote, read with its declared schema
    def new_folder(self) -> str:
        return f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"

    @step
    def uploaded_links(self):
        folder = self.new_folder()
        write_table(self.links, folder, order_by=("original_doi", "letter_doi"))
        return read_table(self.spark, folder, "letter_links")

    @step
    def exported(self):
        config = Config(venues=VENUES, start_year=START, end_year=END)
        return run_cohorts(self.uploaded_links, self.refs, self.aps, self.papers, config, self.new_folder())

    @step
    def stances(self):
        return cohorts.stance_counts(self.papers, self.stance, VENUES, START)

    @step
    def features(self):
        return cohorts.attention_features(self.attention, VENUES, START)

    # fields
    @step
    def tagged(self):
        return fields.paper_fields(self.pfos, self.fos, self.papers, VENUES, START)

    @step
    def rolled(self):
        return fields.rollup_fields(self.tagged, self.field_parents)

    @step
    def ref_fields(self):
        return fields.reference_fields(
            self.edges, self.papers, self.pfos, self.field_parents, self.fos, VENUES, START
        )

    @step
    def cite_fields(self):
        return fields.citation_fields(
            self.edges, self.papers, self.pfos, self.field_parents, self.fos, VENUES, START
        )

    @step
    def ref_diversity(self):
        return fields.simpson_diversity(self.ref_fields, "paper_id", "paper_reference_id", 3)

    @step
    def cite_diversity(self):
        return fields.simpson_diversity(self.cite_fields, "cited_paper_id", "citing_paper_id", 10, strict=True)

    @step
    def main_field(self):
        return fields.dominant_field(self.pfos, self.field_parents, self.fos)

    @step
    def norm_impact(self):
        return fields.field_normalised_impact(self.refs, self.papers, self.pfos, self.fos)

    @step
    def cell_norm(self):
        return fields.cell_normalised_impact(self.tagged, self.cohort_table, 6)


    # stage hand-offs: several branches of one query read these, so they are written once
    @step
    def stacked_table(self):
        return cut_lineage(self.stacked)

    @step
    def cohort_table(self):
        return cohorts.collapse_venues(self.stacked_table)

    @step
    def treated_table(self):
        return cut_lineage(self.treated)

    @step
    def rolled_table(self):
        return cut_lineage(self.rolled)

    @step
    def ref_diversity_table(self):
        return cut_lineage(self.ref_diversity)

    @step
    def cite_diversity_table(self):
        return cut_lineage(self.cite_diversity)

    @step
    def novelty_table(self):
        return cut_lineage(self.novelty)

    # ranks
    @step
    def cells(self):
        return ranking.with_period(fields.field_cells(self.rolled_table, self.cohort_table))

    @step
    def histogram_ranks(self):
        return ranking.cell_percentile_rank(
            self.cells, "impact_3year", by=("venue", "type", "period", "id"), skip_null=False, out="mu_rank",
            few_values=True,
        )

    @step
    def panel_cells(self):
        return fields.field_cells(self.rolled_table, ranking.with_period(self.stacked_table))

    def panel_rank(self, scores: DataFrame | None, metric: str, **options) -> DataFrame:
        rows = self.panel_cells if scores is None else self.panel_cells.join(scores, "id", "left")
        return ranking.cell_percentile_rank(rows, metric, **options)

    @step
    def impact_ranks(self):
        return self.panel_rank(None, "impact_3year", few_values=True)

    @step
    def reference_ranks(self):
        return self.panel_rank(self.ref_diversity_table, "simpson")

    @step
    def citation_ranks(self):
        return self.panel_rank(self.cite_diversity_table, "simpson")

    @step
    def novelty_ranks(self):
        return self.panel_rank(self.novelty_table, "zscore_10th", descending=True, skip_null=False)

    @step
    def panel(self):
        return ranking.metric_panel(self.impact_ranks, self.reference_ranks, self.citation_ranks, self.novelty_ranks)

    @step
    def panel_table(self):
        return cut_lineage(self.panel)

    @step
    def likelihood(self):
        return ranking.binned_likelihood(self.cohort_table, 1.2)

    # trajectories
    @step
    def dual(self):
        return trajectories.dual_trajectories(self.letters, self.edges, self.refs, self.authorships, self.papers)

    @step
    def titles(self):
        return trajectories.citing_titles(self.letters, self.edges, self.papers)

    @step
    def clean(self):
        return trajectories.drop_replies(cohorts.collapse_venues(self.dual), self.titles)

    @step
    def clean_table(self):
        return cut_lineage(self.clean)

    @step
    def annual(self):
        return trajectories.annual_citations(self.clean)

    @step
    def cocite(self):
        return trajectories.cocitation(self.clean, self.treated)

    @step
    def displayed(self):
        raw = trajectories.raw_trajectory(self.clean_table, self.treated_table)
        both = trajectories.cocite_trajectory(
            trajectories.cocitation(self.clean_table, self.treated_table), self.treated_table
        )
        return trajectories.within_years(raw.unionByName(both))

    # novelty
    ITERATIONS = 10

    @step
    def shuffled(self):
        return novelty.shuffle_within(
            self.brand_refs, ["citing_year", "reference_year"], "reference_journal_id", "citing_paper_id", "row_key",
            self.ITERATIONS,
        )

    @step
    def observed_pairs(self):
        return novelty.pair_counts(self.brand_refs, ["citing_year"])

    @step
    def null_pairs(self):
        return novelty.pair_counts(self.shuffled, ["citing_year", "iteration"])

    @step
    def zscores(self):
        return novelty.pair_zscores(self.observed_pairs, self.null_pairs, self.ITERATIONS)

    @step
    def zscore_table(self):
        return cut_lineage(self.zscores)

    @step
    def stacked_zscores(self):
        years = range(START, END)
        return novelty.stack_zscores({y: self.zscore_table.filter(F.col("year") == y).drop("year") for y in years})

    @step
    def novelty(self):
        return novelty.paper_novelty(
            self.zscores, self.stacked_table, self.brand_refs.select("citing_paper_id", "reference_journal_id"), START, END - 1
        )

    # people
    @step
    def positions(self):
        return authors.author_positions(self.authorships)

    @step
    def targets(self):
        return authors.target_authors(self.authorships, self.papers, VENUES, START, END)

    @step
    def histories(self):
        return authors.career_histories(
            self.authorships, self.papers, self.targets, self.norm_impact, self.main_field, 1980, 2020
        )

    @step
    def profiles(self):
        return authors.author_profiles(
            self.targets, self.authorships, self.affiliations, self.authors, self.gender_names
        )

    @step
    def histories_table(self):
        return cut_lineage(self.histories)

    def events_of(self, position: str) -> DataFrame:
        return authors.author_events(
            self.treated_table, self.controls, self.histories_table, position, START, END - 1, 4
        )

    def features_of(self, position: str) -> DataFrame:
        return authors.career_features(self.histories_table, self.events_of(position), 5, 1, 5)

    @step
    def author_features(self):
        return self.features_of("f")

    @step
    def author_feature_table(self):
        """First and last authors, told apart by `authorship`."""
        names = {"f": "first", "l": "last"}
        return cut_lineage(cohorts.gather(*[self.features_of(p).withColumn("authorship", F.lit(n)) for p, n in names.items()]))

    # matching inputs
    @step
    def prepared(self):
        return matching.prepare_paper_match(
            self.treated_table, self.controls, self.rolled, delays=(3,), min_treated=1
        )

    @step
    def prepared_pooled(self):
        return matching.prepare_density_match(self.treated_table, self.controls, self.rolled)

    # matching on estimated propensities
    @step
    def matched_papers(self):
        """Matched papers of every venue, delay, lag and tolerance."""
        frame, grid = ["venue", "delay", "lag"], [f"tol_{c}" for c in PAPER_GRID[0]]
        rows = matching.prepare_paper_match(self.treated_table, self.controls, self.rolled, delays=DELAYS, min_treated=1)
        scored = cut_lineage(models.propensity(cut_lineage(rows), frame, ["year", "impact_norm"]))
        pairs = matching.nearest_match(scored, frame, ["field", "quarter", "multifield"], PAPER_GRID[0], grid=PAPER_GRID)
        return cut_lineage(matching.match_groups(pairs, [*frame, *grid, "subclass"], "impact_before", "impact_after"))

    @step
    def paper_pairs(self):
        return at_cell(self.matched_papers.filter(F.col("delay") == DELAYS[0]), PAPER_CELL)

    @step
    def paper_pairs_table(self):
        return cut_lineage(cohorts.collapse_venues(self.paper_pairs))

    @step
    def matched_authors(self):
        """Both career windows of matched first and last authors, for every venue, event year and tolerance."""
        frame, grid = ["authorship", "venue", "event_year"], [f"tol_{c}" for c in AUTHOR_GRID[0]]
        rows = self.author_feature_table.filter(F.col("partition") == "before").withColumn(
            "unit", F.concat_ws("|", "author_id", "treat")
        )
        scored = models.propensity(
            rows, frame, ["prod_norm", "lead_prod_norm", "impact_norm", "career_age"], ["field"]
        )
        pairs = matching.nearest_match(cut_lineage(scored), frame, [], AUTHOR_GRID[0], unit="unit", grid=AUTHOR_GRID)
        named = matching.match_groups(pairs, [*frame, *grid, "subclass"])
        return cut_lineage(authors.author_match_rows(named, self.author_feature_table, ["authorship"], grid))

    @step
    def author_pairs_table(self):
        return cut_lineage(cohorts.collapse_venues(at_cell(self.matched_authors, AUTHOR_CELL)))

    @step
    def first_author_pairs(self):
        return self.author_pairs_table.filter(F.col("authorship") == "first")

    @step
    def author_diagnostics(self):
        grid = cohorts.collapse_venues(self.matched_authors).drop("impact").withColumnsRenamed(
            {"tol_impact_norm": "impact", "tol_prod_norm": "productivity"}
        )
        return reports.author_match_diagnostics(cohorts.collapse_venues(self.treated_table), grid, "citations")

    @step
    def paper_diagnostics(self):
        grid = cohorts.collapse_venues(self.matched_papers).select(
            "venue", "delay", "lag", "type", "match_group", "growth", F.col("tol_impact_norm").alias("impact"),
            F.col("tol_year").cast("int").alias("year"),
        )
        cells = [(d, c["impact_norm"], int(c["year"])) for d in DELAYS for c in PAPER_GRID]
        return reports.paper_match_diagnostics(cohorts.collapse_venues(self.treated_table), grid, cells, observed_lag=12)

    @step
    def matched_pooled(self):
        scored = models.propensity(cut_lineage(self.prepared_pooled), [], ["year", "impact_norm"])
        pairs = matching.nearest_match(
            scored, [], ["venue", "field", "quarter", "multifield"], {"impact_norm": 0.5, "year": 3.0}, std_caliper=False
        )
        return matching.match_groups(pairs, ["venue", "subclass"])

    @step
    def covariates(self):
        first = authors.first_year(self.histories_table, self.profiles, "f")
        return authors.author_covariates(
            self.profiles, first, self.elite,
            self.prepared_pooled.select("id", "venue", "type", "treat", "year", "impact_norm"), "f", 2,
        )

    @step
    def effects(self):
        rows = cut_lineage(cohorts.collapse_venues(self.covariates)).withColumns(
            {
                "female": F.when(F.col("gender") == "Female", 1.0).otherwise(0.0),
                "senior": F.when(F.col("seniority") == "Senior", 1.0).when(F.col("seniority") == "Junior", 0.0),
                "at_elite": F.when(F.col("elite") == "Elite", 1.0).otherwise(0.0),
                "team_mid": F.when(F.col("team") == "(1,5]", 1.0).when(F.col("team").isNotNull(), 0.0),
                "team_big": F.when(F.col("team") == "(5,20]", 1.0).when(F.col("team").isNotNull(), 0.0),
            }
        )
        return models.marginal_effects(
            rows, {"gender": "female", "seniority": "senior", "elite": "at_elite"},
            ["team_mid", "team_big", "impact", "year_offset"],
        )

    # titles and vectors
    @step
    def similarities(self):
        pairs = self.titles.filter(F.col("citing_title").isNotNull()).select("cited_paper_id", "citing_paper_id")
        scored = similarity.embedding_similarity(
            pairs, self.paper_vectors, "paper_id", "cited_paper_id", "citing_paper_id"
        )
        return scored.select(
            F.col("cited_paper_id").alias("cited_id"), F.col("citing_paper_id").alias("citing_id"),
            rounded(F.col("cosine_similarity")).alias("cosine_similarity"),
        )

    @step
    def cociter_ranks(self):
        cocite = trajectories.cocitation(self.clean_table, self.treated_table)
        return similarity.cociter_rank(self.similarities, cocite)

    # tests
    @step
    def one_sample(self):
        return statistics.ks_one_sample(
            self.panel_table.filter(F.col("type") == "letter"), ["venue", "metric"]
        )

    @step
    def two_sample(self):
        rows = statistics.matched_ranks(self.panel_table, self.paper_pairs_table)
        return statistics.ks_two_sample(rows, ["venue", "metric"])

    @step
    def lag_pairs(self):
        return statistics.paired_arms(
            statistics.by_lag_type(self.paper_pairs_table), ["venue", "lagtype"], "match_group", "type", "growth",
            "Control", "Treatment",
        )

    @step
    def paper_comparison(self):
        keys = ["venue", "lagtype"]
        tests = statistics.paired_t(self.lag_pairs, keys).select(*keys, F.round("t_p_value", 4).alias("t_p_value"))
        return statistics.paired_difference(self.lag_pairs, keys).join(tests, keys, "left")

    @step
    def author_comparison(self):
        keys, out = ["venue", "authorship"], []
        for metric in ("impact_raw", "frac_prod"):
            changes = reports.author_changes(self.author_pairs_table, metric, ["authorship"])
            pairs = statistics.paired_arms(changes, keys, "match_group", "treat", "change", 0, 1)
            tests = statistics.paired_t(pairs, keys).select(*keys, F.round("t_p_value", 4).alias("t_p_value"))
            out.append(statistics.paired_difference(pairs, keys).join(tests, keys, "left").withColumn("metric", F.lit(metric)))
        return cohorts.gather(*out)


QUERIES = {
    "union_refs": lambda w: w.edges,
    "reference_counts": lambda w: graph.reference_counts(w.edges),
    "windowed_impact": lambda w: w.impact,
    "resolve_links": lambda w: w.letters,
    "treated_cohort": lambda w: w.treated,
    "control_cohort": lambda w: w.controls,
    "stack_cohorts": lambda w: w.stacked,
    "collapse_venues": lambda w: w.cohort,
    "gather": lambda w: w.gathered,
    "upload_links": lambda w: w.uploaded_links,
    "export_letters": lambda w: w.exported["letter_metadata"],
    "export_treated": lambda w: w.exported["agg_letters"],
    "export_controls": lambda w: w.exported["agg_nonletters"],
    "cohort_counts": lambda w: cohorts.cohort_counts(w.stacked),
    "stance_counts": lambda w: w.stances,
    "attention_features": lambda w: w.features,
    "paper_fields": lambda w: w.tagged,
    "rollup_fields": lambda w: w.rolled,
    "reference_fields": lambda w: w.ref_fields,
    "citation_fields": lambda w: w.cite_fields,
    "simpson_references": lambda w: r6(w.ref_diversity, "simpson"),
    "simpson_citations": lambda w: r6(w.cite_diversity, "simpson"),
    "field_representation": lambda w: r6(fields.field_representation(w.rolled, w.cohort, FIELD_NAMES, 3), "ratio"),
    "dominant_field": lambda w: w.main_field,
    "field_normalised_impact": lambda w: r6(w.norm_impact, "impact_3year_norm"),
    "cell_normalised_impact": lambda w: r6(w.cell_norm, "raw_impact", "norm_impact"),
    # ranks and attention
    "cell_percentile_rank": lambda w: r6(w.histogram_ranks, "mu_rank"),
    "rank_reference_diversity": lambda w: r6(w.reference_ranks, "rank"),
    "rank_citation_diversity": lambda w: r6(w.citation_ranks, "rank"),
    "rank_novelty": lambda w: r6(w.novelty_ranks, "rank"),
    "rank_histogram": lambda w: r6(ranking.rank_histogram(w.histogram_ranks), "prop"),
    "binned_likelihood": lambda w: r6(w.likelihood, "binedge", "p_with_letter", "p_no_letter", "p_ratio"),
    "loglog_corr": lambda w: r6(ranking.loglog_corr(w.likelihood), "rho"),
    "metric_panel": lambda w: r6(w.panel, "rank"),
    "matched_panel": lambda w: r6(ranking.matched_panel(w.panel, w.paper_pairs), "rank"),
    "top_share": lambda w: r6(attention.top_share(w.features, w.cohort_table), "prop_hit"),
    "attention_share": lambda w: r6(attention.attention_share(w.paper_pairs_table, w.features), "prop"),
    "attention_crosstab_tweets": lambda w: r6(
        attention.attention_crosstab(w.letters, w.attention, "tweet_count", TWEET_BREAKS, TWEET_LABELS), "prop"),
    "attention_crosstab_news": lambda w: r6(
        attention.attention_crosstab(w.letters, w.attention, "newsfeed_count", NEWS_BREAKS, NEWS_LABELS), "prop"),
    # trajectories
    "dual_trajectories": lambda w: w.dual,
    "self_cite_flag": lambda w: trajectories.self_cite_flag(
        w.refs.select(F.col("paper_reference_id").alias("id"), F.col("paper_id").alias("citing_id")), w.authorships),
    "citing_titles": lambda w: w.titles,
    "drop_replies": lambda w: w.clean,
    "annual_citations": lambda w: w.annual,
    "citation_ratio": lambda w: r6(
        trajectories.citation_ratio(trajectories.annual_citations(w.clean_table), w.treated_table), "mu"),
    "cocitation": lambda w: w.cocite,
    "cocite_trajectory": lambda w: r6(trajectories.cocite_trajectory(w.cocite, w.treated), "mu"),
    "raw_trajectory": lambda w: r6(trajectories.raw_trajectory(w.clean, w.treated), "mu"),
    "trajectory_slope": lambda w: r6(trajectories.trajectory_slope(w.displayed), "last_val"),
    # novelty
    "journal_refs": lambda w: novelty.journal_refs(w.edges, w.papers, w.journals, 100),
    "target_journal_refs": lambda w: novelty.target_journal_refs(w.refs, w.papers, w.journals, VENUES, 100, START),
    "shuffle_within": lambda w: w.shuffled,
    "pair_counts": lambda w: w.observed_pairs,
    "pair_counts_null": lambda w: w.null_pairs,
    "merge_pair_counts": lambda w: novelty.merge_pair_counts(
        w.observed_pairs.select("j1", "j2", "n"), w.null_pairs.select("j1", "j2", "n")),
    "pair_zscores": lambda w: score_kind(w.zscores, "z"),
    "stack_zscores": lambda w: score_kind(w.stacked_zscores, "z"),
    "paper_novelty": lambda w: score_kind(score_kind(w.novelty, "zscore_median"), "zscore_10th"),
    # people
    "author_positions": lambda w: w.positions,
    "target_authors": lambda w: w.targets,
    "career_histories": lambda w: r6(w.histories, "impact_3year_norm"),
    "author_profiles": lambda w: w.profiles,
    "first_year": lambda w: authors.first_year(w.histories, w.profiles, "f"),
    "author_covariates": lambda w: r6(w.covariates, "impact"),
    "career_features": lambda w: r6(
        w.author_features, "frac_prod", "lead_prod", "impact", "impact_raw", "impact_norm", "prod_norm", "lead_prod_norm"),
    "author_events": lambda w: w.events_of("f"),
    "elite_universities": lambda w: authors.elite_universities(w.rankings, w.grid_ids, 80, 30),
    # matching
    "prepare_paper_match": lambda w: r6(w.prepared, "impact_norm"),
    "prepare_density_match": lambda w: r6(w.prepared_pooled, "impact_norm"),
    "propensity": lambda w: r6(
        models.propensity(w.prepared_pooled, [], ["year", "impact_norm"]), "impact_norm", "distance"),
    "nearest_match": lambda w: r6(w.matched_papers, "impact_norm", "distance", "growth"),
    "nearest_match_pooled": lambda w: r6(w.matched_pooled, "impact_norm", "distance"),
    "nearest_match_authors": lambda w: r6(
        w.matched_authors, "frac_prod", "lead_prod", "impact", "impact_raw", "impact_norm", "prod_norm", "lead_prod_norm"),
    "match_groups": lambda w: r6(w.paper_pairs, "growth", "impact_norm", "distance"),
    "paper_match_diagnostics": lambda w: r6(w.paper_diagnostics, "t_estimate", "t_statistic", "wilcoxon_statistic"),
    "author_match_diagnostics": lambda w: r6(w.author_diagnostics, "t_estimate", "t_statistic", "wilcoxon_statistic"),
    "balance_table": lambda w: matching.balance_table(w.first_author_pairs),
    "match_impact_summary": lambda w: matching.match_impact_summary(w.paper_pairs_table),
    "match_impact_summary_authors": lambda w: matching.match_impact_summary(
        w.first_author_pairs.filter(F.col("partition") == "before"), "impact_raw", "treat", 3),
    # tests and reports
    "ks_one_sample": lambda w: r6(w.one_sample, "ks_statistic", "ks_p_value", "mu"),
    "ks_two_sample": lambda w: r6(w.two_sample, "ks2_statistic", "ks2_p_value", "mu_letter", "mu_article"),
    "paired_t": lambda w: r6(
        statistics.paired_t(w.lag_pairs, ["venue", "lagtype"]), "t_estimate", "t_statistic", "t_p_value"),
    "wilcoxon_signed_rank": lambda w: r6(
        statistics.wilcoxon_signed_rank(w.lag_pairs, ["venue", "lagtype"]), "wilcoxon_statistic", "wilcoxon_p_value"),
    "paired_difference": lambda w: r6(w.paper_comparison, "mean_diff", "interval", "upper", "lower"),
    "paired_difference_authors": lambda w: r6(w.author_comparison, "mean_diff", "interval", "upper", "lower"),
    "arm_means": lambda w: r6(
        statistics.arm_means(statistics.by_lag_type(w.paper_pairs_table), ["venue", "type", "lagtype"], "growth"),
        "mu", "interval", "upper", "lower"),
    "significance": lambda w: r6(
        statistics.comparison_panels(w.paper_comparison, w.author_comparison), "mean_diff", "upper", "lower"),
    "significance_lag": lambda w: r6(
        statistics.lag_panels(w.paper_comparison), "mean_diff", "interval", "upper", "lower"),
    "marginal_effects": lambda w: r6(w.effects, "ame", "se", "z", "p", "lower", "upper"),
    "pseudo_r2": lambda w: models.pseudo_r2(w.cell_norm, ["raw_impact", "norm_impact"]),
    "diagnostics_report_counts": lambda w: reports.diagnostics_report(
        w.paper_diagnostics, "counts", reports.PAPER_PARAMS, reports.PAPER_SLICES),
    "diagnostics_report_tstats": lambda w: reports.diagnostics_report(
        w.author_diagnostics, "tstats", reports.AUTHOR_PARAMS, reports.AUTHOR_SLICES, True),
    "diagnostics_report_wilcox": lambda w: reports.diagnostics_report(
        w.paper_diagnostics, "wilcox", reports.PAPER_PARAMS, reports.PAPER_SLICES),
    "ks_report": lambda w: reports.ks_report(w.one_sample, w.two_sample),
    "ks_report_cociters": lambda w: reports.ks_report(
        statistics.ks_one_sample(w.cociter_ranks, ["venue"], unit="citing_id"), keys=("venue",)),
    # titles and vectors
    "fuzzy_title_links": lambda w: linkage.fuzzy_title_links(w.title_papers, 1, 4, 2000, 2020),
    "embedding_similarity": lambda w: w.similarities,
    "embed_titles": lambda w: similarity.title_vectors(w.titles, similarity.hashing_encoder()).select(
        "title", F.size("embedding").alias("dim"),
        rounded(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("length")),
    "cociter_rank": lambda w: r6(w.cociter_ranks, "rank"),
}
