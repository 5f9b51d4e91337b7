"""Queries against their SQL on the smallest tables; LETTERMARK_ALL=1 adds the long chains."""

import os

import pytest

import compare
from lettermark.plans.oracle import QUERIES as SQL
from lettermark.plans.workbench import QUERIES

FOLDER = "/root/testdata/sf0.001"
SHORT = [
    "union_refs", "reference_counts", "windowed_impact", "resolve_links", "treated_cohort", "control_cohort",
    "stance_counts", "attention_features", "rollup_fields", "reference_fields", "citation_fields",
    "simpson_references", "dominant_field", "field_normalised_impact", "cell_percentile_rank", "rank_histogram",
    "dual_trajectories", "citing_titles", "cocitation", "journal_refs", "target_journal_refs", "shuffle_within",
    "pair_counts", "author_positions", "career_histories", "author_profiles", "elite_universities",
    "prepare_paper_match", "match_groups", "fuzzy_title_links", "embedding_similarity",
]
NAMES = list(QUERIES) if os.environ.get("LETTERMARK_ALL") else SHORT


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare.compare(spark, con, FOLDER, name)[2] == ""


def test_every_sql_has_its_query():
    assert SQL <= set(QUERIES)
