"""Finding letter-original links from comment titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title patterns in order of priority.
QUOTED = r"""["“`]{1,2}([^"”'']+)["”'']{1,2}"""
COMMENT_PATTERNS = (QUOTED, "Comment on: (.+)$", "Comment on (.+)$")


def extracted_title(column: Column) -> Column:
    """The title a comment talks about: quoted text first, then the text after "Comment on"."""
    hits = [F.nullif(F.regexp_extract(column, p, 1), F.lit("")) for p in COMMENT_PATTERNS]
    return F.trim(F.coalesce(*hits))


def fuzzy_title_links(
    papers: DataFrame, journal_id: int, max_dist: int = 4, start_year: int = 2000, end_year: int = 2020
) -> DataFrame:
    """(original_doi, letter_doi) for comments whose extracted title is within `max_dist` edits of a title.

    Distinct lower-cased titles are compared, not papers. A title at distance d <= max_dist shares at least one
    of max_dist + 1 pieces of the comment title, moved by few characters, so pieces give an equi-join and only its
    hits are measured. Titles too short to cut are compared by length alone.
    """
    scope = papers.filter(F.col("journal_id") == journal_id)
    usable = lambda c: c.isNotNull() & (c != "")
    comments = (
        scope.filter(
            F.lower("original_title").like("comment%")
            & F.col("year").between(start_year, end_year)
            & usable(F.col("doi"))
        )
        .select(F.col("doi").alias("letter_doi"), F.lower(extracted_title(F.col("original_title"))).alias("wanted"))
        .filter(F.col("wanted").isNotNull())
    )
    originals = scope.filter(usable(F.col("doi")) & F.col("original_title").isNotNull()).select(
        F.col("doi").alias("original_doi"), F.lower("original_title").alias("title")
    )
    wanted = comments.select("wanted").distinct()
    titles = originals.select("title").distinct()

    pieces = max_dist + 1
    # Lengths whose pieces would be empty: every title up to twice the distance below goes by length.
    short = F.length("wanted") < pieces
    # piece i of a comment title covers [floor(i * len / pieces), floor((i + 1) * len / pieces))
    size = F.length("wanted")
    cut = lambda i: F.floor(i * size / pieces).cast("int")
    probe = (
        wanted.filter(~short)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        .select(
            "wanted", "i",
            F.expr("wanted").substr(cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("piece"),
            cut(F.col("i")).alias("start"),
            size.alias("want_len"),
        )
    )
    # Every comment length in reach of a title, and there the text at each place that a piece can have moved to. Of the
    # pieces without edits, take the first i with as many edits before it as pieces, i; at most max_dist - i are behind
    # it. So it has moved by at most i from the start and by at most max_dist - i from the end of the title.
    length = F.length("title")
    reach = F.sequence(F.greatest(length - max_dist, F.lit(pieces)), length + max_dist)
    longer, i = length - F.col("want_len"), F.col("i")
    low = F.greatest(F.col("_from") + F.greatest(-i, longer - (max_dist - i)), F.lit(0))
    high = F.least(F.col("_from") + F.least(i, longer + (max_dist - i)), length - F.col("_size"))
    # dealt out by number: a small table of titles would be left in one task, which makes many pieces of each
    tasks = int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = (
        titles.repartition(tasks, F.xxhash64("title"))
        .withColumn("want_len", F.explode(F.when(length + max_dist >= pieces, reach)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
        .withColumn("_from", F.floor(i * F.col("want_len") / pieces).cast("int"))
        .withColumn("_size", F.floor((i + 1) * F.col("want_len") / pieces).cast("int") - F.col("_from"))
        .withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high))))
        .select("title", "want_len", "i", F.expr("substring(title, _at + 1, _size)").alias("piece"))
    )
    # merged: the planner takes the pieces for as small as the titles and would collect them for a broadcast
    near = probe.join(grams.hint("merge"), ["want_len", "i", "piece"]).select("wanted", "title")
    tiny = (
        wanted.filter(short)
        .withColumn("n", F.explode(F.sequence(F.greatest(size - max_dist, F.lit(0)), size + max_dist)))
        .join(titles.withColumn("n", F.length("title")), "n")
        .select("wanted", "title")
    )
    hits = (
        near.unionByName(tiny).distinct().filter(F.levenshtein("wanted", "title", max_dist).between(0, max_dist))
    )
    return (
        comments.join(hits, "wanted").join(originals, "title").select("original_doi", "letter_doi")
    )
