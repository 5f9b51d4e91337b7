import random

import pytest
from pyspark.sql import functions as F

from lettermark.operators import authors, cohorts, fields, graph, linkage, trajectories

PAPERS = "paper_id bigint, doi string, year int, month int, journal_id bigint, doc_type string, doc_sub_types string"


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(
        [
            (1, "10.A/1", 2000, 1, 7, "Journal", ""),
            (2, "10.A/2", 2001, None, 7, "Journal", None),
            (3, "10.A/3", 1999, 5, 9, "Journal", ""),
            (4, "10.A/4", 2003, 6, 9, "Conference", ""),
            (5, "10.A/5", None, 6, 9, "Journal", ""),
            (6, "10.A/1", 2002, 6, 7, "Journal", "r"),
        ],
        PAPERS,
    )


def test_edges_fold_case_and_keep_unknown(spark, papers):
    refs = spark.createDataFrame([(3, 1), (3, 1)], "paper_id bigint, paper_reference_id bigint")
    aps = spark.createDataFrame([("10.a/3", "10.a/2"), ("10.A/3", "10.A/2"), ("10.a/3", "10.a/none"), ("10.a/4", "10.a/1")], "citing_doi string, cited_doi string")
    got = sorted(map(tuple, graph.union_refs(refs, aps, papers).collect()), key=str)
    # paper 1 and 6 share a DOI, so the last pair gives two edges
    assert got == sorted([(3, 1), (3, 2), (3, None), (4, 1), (4, 6)], key=str)


def test_impact_has_no_lower_bound(spark, papers):
    edges = spark.createDataFrame([(3, 1), (4, 1), (5, 1), (6, 1)], "paper_id bigint, paper_reference_id bigint")
    row = graph.windowed_impact(edges, papers, {"V": 7}, range(1, 4), 2000).collect()
    assert len(row) == 1 and row[0].id == 1 and row[0].venue == "V" and row[0].reference_count is None
    # paper 3 is older (counts), 4 is no journal, 5 has no year (counts nowhere), 6 came two years later
    assert (row[0].impact_1year, row[0].impact_2year, row[0].impact_3year) == (1, 2, 2)
    bounded = graph.windowed_impact(edges, papers, {"V": 7}, range(1, 4), 2000, min_lag=0).first()
    assert (bounded.impact_1year, bounded.impact_3year) == (0, 1)


def test_links_and_treated(spark, papers):
    links = spark.createDataFrame([("10.A/2", "10.A/3", "V"), ("10.A/5", "none", "V")], "original_doi string, letter_doi string, venue string")
    got = {r.original_id: r for r in cohorts.resolve_links(links, papers).collect()}
    assert got[2].retracted == 1 and got[5].retracted == 0 and got[5].letter_id is None
    letters = spark.createDataFrame(
        [(1, 11, 2000, 2003, 0, "V"), (1, 10, 2000, 2001, 0, "V"), (1, 12, 2000, None, 0, "V"), (2, 13, 2001, 2002, 1, "V"), (3, 14, 1999, 2000, 0, "V"), (4, 15, 2001, 2000, 0, "V")],
        "original_id bigint, letter_id bigint, original_year int, letter_year int, retracted int, venue string",
    )
    impact = spark.createDataFrame([(i, 2000, 1, 9, "V", 5) for i in (1, 2, 3, 4, 10, 20)] + [(21, 2000, 1, 4, "V", 5)], "id bigint, year int, month int, reference_count bigint, venue string, impact_1year bigint")
    treated = {r.id: r for r in cohorts.treated_cohort(letters, impact).collect()}
    assert set(treated) == {1, 4}
    assert (treated[1].letter_id, treated[1].lag, treated[1].num_critical_letters) == (10, 1, 3)
    assert treated[4].lag == -1
    assert {r.id for r in cohorts.control_cohort(impact, letters).collect()} == {20}


def test_self_citation_needs_known_author(spark):
    cites = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "id bigint, citing_id bigint")
    names = spark.createDataFrame([(1, 100), (1, None), (2, 100), (3, None)], "paper_id bigint, author_id bigint")
    got = {r.citing_id: r.is_self_cite for r in trajectories.self_cite_flag(cites, names).collect()}
    assert got == {2: True, 3: False, 4: False}


def test_positions_and_diversity(spark):
    a = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (2, 11, 2), (3, 1, 1), (3, 2, 2), (3, 3, 3)], "paper_id bigint, author_id bigint, seq int")
    got = {(r.paper_id, r.author_id): r.author_position for r in authors.author_positions(a).collect()}
    assert got == {(1, 10): "f", (2, 10): "f", (2, 11): "l", (3, 1): "f", (3, 2): "m", (3, 3): "l"}
    pairs = spark.createDataFrame([(1, r, f) for r, f in ((1, "x"), (2, "x"), (3, "y"), (3, "z"))], "p int, r int, field string")
    assert fields.simpson_diversity(pairs, "p", "r", 3).first().simpson == pytest.approx(-(4 + 1 + 1) / 16)
    assert fields.simpson_diversity(pairs, "p", "r", 3, strict=True).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_title_links_equal_brute_force(spark):
    rng = random.Random(2)
    titles = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 16))).strip() or "a" for _ in range(60)]
    rows = [(i, f"o{i}", 1, 2005, t) for i, t in enumerate(titles)]
    for i, t in enumerate(titles):
        s = list(t)
        for _ in range(rng.randrange(0, 7)):
            op, k = rng.randrange(3), rng.randrange(len(s) + 1)
            s[k : k + (op > 0)] = [] if op == 1 else [rng.choice("abé")]
        rows.append((1000 + i, f"c{i}", 1, 2005, "Comment on: " + ("".join(s).strip() or "b")))
    df = spark.createDataFrame(rows, "paper_id bigint, doi string, journal_id bigint, year int, original_title string")
    got = sorted((r.original_doi, r.letter_doi) for r in linkage.fuzzy_title_links(df, 1).collect())
    want = sorted(
        (o[1], c[1]) for c in rows if c[0] >= 1000 for o in rows if edit(c[4][12:].strip().lower(), o[4].lower()) < 5
    )
    assert got == want


def test_titles_by_priority(spark):
    df = spark.createDataFrame([('Comment on "The Title"',), ("Comment on: X y",), ("Comment on Z",), ("comment: none",)], "t string")
    got = [r.x for r in df.select(linkage.extracted_title(F.col("t")).alias("x")).collect()]
    assert got == ["The Title", "X y", "Z", None]
