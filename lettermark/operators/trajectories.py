"""Who cites a criticised paper and its letter, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def self_cite_flag(citations: DataFrame, authorships: DataFrame) -> DataFrame:
    """(id, citing_id, is_self_cite): true when both papers share an author; unknown authors never match."""
    pairs = citations.select("id", "citing_id").distinct()
    names = authorships.filter(F.col("author_id").isNotNull()).select("paper_id", "author_id").distinct()
    citing = names.withColumnRenamed("paper_id", "citing_id")
    cited = names.withColumnRenamed("paper_id", "id")
    shared = (
        pairs.join(citing, "citing_id").join(cited, ["id", "author_id"], "left_semi").select("id", "citing_id").distinct()
    )
    return pairs.join(shared.withColumn("_s", F.lit(True)), ["id", "citing_id"], "left").select(
        "id", "citing_id", F.coalesce("_s", F.lit(False)).alias("is_self_cite")
    )


def dual_trajectories(
    letters: DataFrame, edges: DataFrame, refs: DataFrame, authorships: DataFrame, papers: DataFrame,
    keep_multiplicity: bool = True,
) -> DataFrame:
    """Citations of both members of every link: letters through all edges, originals through native edges.

    A paper that occurs in several links repeats its citations once per link unless `keep_multiplicity` is off.
    """

    def members(column: str, kind: str) -> DataFrame:
        return (
            letters.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("id"), "venue")
            .agg(F.count(F.lit(1)).cast("int").alias("_m"))
            .withColumn("type", F.lit(kind))
        )

    as_cites = lambda df: df.select(F.col("paper_id").alias("citing_id"), F.col("paper_reference_id").alias("id"))
    cites = (
        as_cites(edges)
        .join(members("letter_id", "letter"), "id")
        .unionByName(as_cites(refs).join(members("original_id", "original"), "id"))
    )
    years = papers.select(F.col("paper_id").alias("citing_id"), F.col("year").alias("citing_year"))
    flags = self_cite_flag(cites, authorships)
    out = cites.join(flags, ["id", "citing_id"], "left").join(years, "citing_id", "left")
    if keep_multiplicity:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_m")))
    return out.select("id", "citing_id", "type", "citing_year", "venue", "is_self_cite")


def citing_titles(letters: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Title of every criticised paper next to the titles of the papers citing it."""
    originals = letters.filter(F.col("original_id").isNotNull()).select(
        F.col("original_id").alias("paper_reference_id")
    ).distinct()
    cites = (
        edges.join(originals, "paper_reference_id")
        .select(F.col("paper_reference_id").alias("cited_paper_id"), F.col("paper_id").alias("citing_paper_id"))
        .distinct()
    )
    titles = papers.select("paper_id", "title")
    cited = titles.select(F.col("paper_id").alias("cited_paper_id"), F.col("title").alias("cited_title"))
    citing = titles.select(F.col("paper_id").alias("citing_paper_id"), F.col("title").alias("citing_title"))
    return (
        cites.join(cited, "cited_paper_id", "left")
        .join(citing, "citing_paper_id", "left")
        .select("cited_paper_id", "citing_paper_id", "cited_title", "citing_title")
    )


def drop_replies(trajectories: DataFrame, titles: DataFrame) -> DataFrame:
    """Remove citations from papers whose title contains "reply", and self-citations of any kind."""
    replies = (
        titles.filter(F.col("citing_title").contains("reply"))
        .select(F.col("citing_paper_id").alias("citing_id"))
        .distinct()
    )
    return trajectories.join(replies, "citing_id", "left_anti").filter(~F.col("is_self_cite"))


def annual_citations(trajectories: DataFrame) -> DataFrame:
    """Distinct citing papers per paper, kind and year."""
    return trajectories.groupBy("id", "type", "citing_year", "venue").agg(F.count_distinct("citing_id").alias("cites"))


def citation_ratio(annual: DataFrame, letters: DataFrame) -> DataFrame:
    """Letter over original citations by years since the letter, averaged per venue."""
    links = letters.select(F.col("letter_id").alias("id"), "lag", "original_id", "letter_year")
    letter = (
        annual.filter(F.col("type") == "letter")
        .join(links, "id", "left")
        .select(
            F.col("original_id").alias("id"), "citing_year", "venue", F.col("cites").alias("cites_letter"), "letter_year"
        )
    )
    series = Window.partitionBy("id", "venue")
    filled = series.orderBy("citing_year", "cites_letter").rowsBetween(Window.unboundedPreceding, 0)
    ratio = (
        annual.filter(F.col("type") == "original")
        .select("id", "citing_year", "venue", F.col("cites").alias("cites_original"))
        .join(letter, ["id", "citing_year", "venue"], "left")
        .withColumn("letter_year", F.last("letter_year", ignorenulls=True).over(filled))
        .filter(F.col("citing_year") >= F.col("letter_year"))
        .withColumn("delta_year", F.col("citing_year") - F.min("citing_year").over(series))
    )
    share = F.coalesce("cites_letter", F.lit(0)) / F.col("cites_original")
    return ratio.groupBy("venue", "delta_year").agg(F.avg(share).alias("mu")).withColumn("metric", F.lit("ratio"))


def cocitation(trajectories: DataFrame, letters: DataFrame) -> DataFrame:
    """Whether a citing paper cites both a criticised paper and its letter."""
    links = letters.select("original_id", F.col("letter_id").alias("id")).distinct()
    return (
        trajectories.join(links, "id", "left")
        .groupBy("venue", "citing_id", "citing_year", F.coalesce("original_id", "id").alias("group_id"))
        .agg((F.count(F.lit(1)) > 1).alias("cocite"))
    )


def cocite_trajectory(cocite: DataFrame, letters: DataFrame) -> DataFrame:
    """Mean share of co-citing papers by years since the letter."""
    years = letters.select(F.col("original_id").alias("group_id"), "letter_year")
    return (
        cocite.join(years, "group_id", "left")
        .groupBy("venue", "group_id", (F.col("citing_year") - F.col("letter_year")).alias("delta_year"))
        .agg((F.count_if("cocite") / F.count(F.lit(1))).alias("prop"))
        .groupBy("venue", "delta_year")
        .agg(F.avg("prop").alias("mu"))
        .withColumn("metric", F.lit("cocite"))
    )


def raw_trajectory(trajectories: DataFrame, letters: DataFrame) -> DataFrame:
    """Mean citations of the criticised papers by years since the letter."""
    years = letters.select(F.col("original_id").alias("id"), "letter_year")
    return (
        trajectories.filter(F.col("type") == "original")
        .join(years, "id", "left")
        .groupBy("venue", "id", (F.col("citing_year") - F.col("letter_year")).alias("delta_year"))
        .agg(F.count(F.lit(1)).alias("citations"))
        .groupBy("venue", "delta_year")
        .agg(F.avg("citations").alias("mu"))
        .withColumn("metric", F.lit("raw"))
    )


def within_years(trajectory: DataFrame, first: int = 1, last: int = 8) -> DataFrame:
    """Keep the displayed years since the letter."""
    return trajectory.filter(F.col("delta_year").between(first, last))


def trajectory_slope(trajectory: DataFrame) -> DataFrame:
    """Average yearly change and last value of every venue's series."""
    series = Window.partitionBy("venue", "metric").orderBy("delta_year")
    step = (F.col("mu") - F.lag("mu").over(series)) / (F.col("delta_year") - F.lag("delta_year").over(series))
    slope = F.round("_avg", 3) + F.lit(0.0)
    return (
        trajectory.withColumn("_slope", step)
        .groupBy("venue", "metric")
        .agg(F.avg("_slope").alias("_avg"), F.max_by("mu", "delta_year").alias("last_val"))
        .select(
            "venue",
            "metric",
            slope.alias("avg_slope"),
            F.when(slope.isNotNull(), F.concat(
                F.when(slope < 0, "m = ").otherwise("m = +"), F.regexp_replace(slope.cast("string"), r"\.0$", "")
            )).alias("slope_lab"),
            "last_val",
        )
    )
