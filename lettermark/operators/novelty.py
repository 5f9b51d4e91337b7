"""Combinatorial novelty of reference lists against a shuffled null model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.functions.distribution import hash_digits
from lettermark.functions.keys import md5_key
from lettermark.functions.pairs import counted_pairs
from lettermark.functions.permutation import side_by_side
from lettermark.operators.graph import target_papers
from lettermark.session import cut_lineage

PAIR_BLOCK = 256  # distinct journals on the left side of the pairs one task builds


def _cited_journals(edges: DataFrame, papers: DataFrame, journals: DataFrame, floor: int) -> DataFrame:
    large = journals.filter(F.col("paper_count") > floor).select("journal_id")
    cited = (
        papers.filter(F.col("doi").isNotNull() & (F.col("doc_type") == "Journal"))
        .join(large, "journal_id")
        .select(
            F.col("paper_id").alias("paper_reference_id"),
            F.col("journal_id").alias("reference_journal_id"),
            F.col("year").alias("reference_year"),
        )
    )
    return edges.join(cited, "paper_reference_id")


def journal_refs(
    edges: DataFrame, papers: DataFrame, journals: DataFrame, journal_floor: int = 1000, min_refs: int = 5
) -> DataFrame:
    """Cited journals of every regular article; both journals must be large enough."""
    large = journals.filter(F.col("paper_count") > journal_floor).select("journal_id")
    citing = (
        papers.filter(
            (F.col("doc_type") == "Journal")
            & F.col("doi").isNotNull()
            & (F.col("reference_count") >= min_refs)
            & (F.col("doc_sub_types") == "")
        )
        .join(large, "journal_id")
        .select("paper_id", F.col("year").alias("citing_year"))
    )
    return (
        _cited_journals(edges, papers, journals, journal_floor)
        .join(citing, "paper_id")
        .select(
            F.col("paper_id").alias("citing_paper_id"), "reference_journal_id", "reference_year", "citing_year",
            F.col("paper_reference_id").alias("row_key"),
        )
    )


def target_journal_refs(
    refs: DataFrame, papers: DataFrame, journals: DataFrame, venues: dict[str, int], journal_floor: int = 1000,
    start_year: int = 2000,
) -> DataFrame:
    """Cited journals of the target papers, native edges only and without a reference floor."""
    target = target_papers(papers, venues, start_year).select("paper_id")
    return (
        _cited_journals(refs, papers, journals, journal_floor)
        .join(target, "paper_id")
        .select(F.col("paper_id").alias("citing_paper_id"), "reference_journal_id")
    )


def shuffle_within(
    df: DataFrame, keys: list[str], value: str, unit: str, row_key: str, iterations: int = 10, seed: str = "0",
    digits: int | None = None,
) -> DataFrame:
    """Permute `value` among the rows sharing `keys`, once per iteration.

    A row keeps its hash rank under one seed and receives the value at the same rank under another; both
    orders are spread over hash blocks. (`unit`, `row_key`) must identify a row. Rows with a NULL key drop out.
    The values of a row travel together until the last step, and the rows of a unit come out in one partition, so that
    counting inside units needs no shuffle of its own.
    """
    rows = cut_lineage(df.select(*dict.fromkeys([*keys, value, unit, row_key])).dropna(subset=keys))
    if digits is None:
        digits = hash_digits(rows, keys)
    orders = [md5_key(seed, F.lit("slot"), unit, row_key)] + [md5_key(seed, F.lit(i), unit, row_key) for i in range(1, iterations + 1)]
    dealt = side_by_side(rows, keys, unit, value, orders, digits).repartition(unit)
    runs = F.posexplode("values").alias("_run", "_value")
    return dealt.select(*keys, unit, runs).select(*keys, (F.col("_run") + 1).alias("iteration"), unit, F.col("_value").alias(value))


def _multiplicity_pairs(rows: DataFrame, keys: list[str], paper: str, journal: str) -> DataFrame:
    """Unordered journal pairs of each paper with the number of reference pairs they stand for.

    Repeats are collapsed to counts first, so a paper's list is at most as long as there are journals. Ordinary
    lists are paired inside the task that holds them; long ones are cut into blocks of their left side, which
    are spread over tasks before pairing.
    """
    per = [*keys, paper]
    lists = (
        rows.groupBy(*per, journal)
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy(*per)
        .agg(F.collect_list(F.struct(F.col(journal).alias("j"), "m")).alias("_all"))
    )
    short = lists.filter(F.size("_all") <= PAIR_BLOCK).withColumn("_left", F.col("_all"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / PAIR_BLOCK).cast("int"))
    long = (
        lists.filter(F.size("_all") > PAIR_BLOCK)
        .withColumn("_b", F.explode(blocks))
        .repartition(*per, "_b")
        .withColumn("_left", F.expr(f"slice(_all, _b * {PAIR_BLOCK} + 1, {PAIR_BLOCK})"))
        .drop("_b")
    )
    pairs = (
        short.unionByName(long)
        .select(*per, "_all", F.explode("_left").alias("a"))
        .select(*per, "a", F.explode(F.filter("_all", lambda y: y["j"] >= F.col("a.j"))).alias("b"))
    )
    m1, m2 = F.col("a.m"), F.col("b.m")
    weight = F.when(F.col("a.j") < F.col("b.j"), m1 * m2).otherwise((m1 * (m1 - 1) / 2).cast("bigint"))
    return pairs.select(*per, F.col("a.j").alias("j1"), F.col("b.j").alias("j2"), weight.alias("weight")).filter(
        F.col("weight") > 0
    )


def pair_counts(
    refs: DataFrame, keys: list[str], paper: str = "citing_paper_id", journal: str = "reference_journal_id"
) -> DataFrame:
    """How often two journals meet in a reference list, per key (year, iteration)."""
    return counted_pairs(refs, keys, paper, journal, PAIR_BLOCK)


def merge_pair_counts(*frames: DataFrame, keys: tuple[str, ...] = ("j1", "j2")) -> DataFrame:
    """Add up pair counts of several tables."""
    return reduce(lambda a, b: a.unionByName(b), frames).groupBy(*keys).agg(F.sum("n").alias("n"))


def pair_zscores(observed: DataFrame, nulls: DataFrame, iterations: int, year: str = "citing_year") -> DataFrame:
    """(observed - mean) / population sd over the iterations; a pair missing from one counts as zero there.

    With zero spread the score is +-infinity, or NaN when observed equals the mean.
    """
    moments = nulls.groupBy(year, "j1", "j2").agg(F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    s, q = F.coalesce("_s", F.lit(0)), F.coalesce("_q", F.lit(0))
    spread = F.lit(iterations) * q - s * s
    gap = F.lit(iterations) * F.col("n") - s
    z = (
        F.when(spread > 0, gap / F.sqrt(spread.cast("double")))
        .when(gap > 0, F.lit(float("inf")))
        .when(gap < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    return observed.join(moments, [year, "j1", "j2"], "left").select(
        F.col(year).alias("year"), "j1", "j2", z.alias("z")
    )


def stack_zscores(parts: dict[int, DataFrame]) -> DataFrame:
    """Per-year score tables as one table with a year column."""
    tagged = [df.withColumn("year", F.lit(y).cast("int")) for y, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def paper_novelty(
    zscores: DataFrame, cohort: DataFrame, refs: DataFrame, year_min: int, year_max: int
) -> DataFrame:
    """Median and 10th percentile of the pair scores of each paper, and its number of pairs.

    A pair unknown in the paper's year scores 0. Percentiles are weighted by the pair counts and interpolate
    linearly, as on the written-out list. Papers whose low percentile is +infinity are dropped; a NaN among
    the scores makes both percentiles NaN.
    """
    focus = cohort.filter(F.col("year").between(year_min, year_max)).select(F.col("id").alias("citing_paper_id"), "year")
    pairs = _multiplicity_pairs(refs.join(focus, "citing_paper_id"), ["year"], "citing_paper_id", "reference_journal_id")
    scored = pairs.join(zscores, ["year", "j1", "j2"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    # equal scores of a paper collapse before the exact percentile is taken
    hist = scored.groupBy("citing_paper_id", "z").agg(F.sum("weight").alias("w"))
    nan = F.lit(float("nan"))
    lost = F.max(F.isnan("z"))
    finite = hist.groupBy("citing_paper_id").agg(
        F.percentile("z", F.array(F.lit(0.5), F.lit(0.1)), F.col("w")).alias("_p"),
        F.sum("w").alias("pairs"),
        lost.alias("_nan"),
    )
    return (
        finite.select(
            F.col("citing_paper_id").alias("id"),
            F.when(F.col("_nan"), nan).otherwise(F.col("_p")[0]).alias("zscore_median"),
            F.when(F.col("_nan"), nan).otherwise(F.col("_p")[1]).alias("zscore_10th"),
            "pairs",
        )
        .filter(F.col("zscore_10th") != float("inf"))
    )
