"""Tweets and news mentions of criticised papers and their letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.functions.binning import edge_label
from lettermark.functions.keys import null_safe_join


def top_share(
    features: DataFrame, cohort: DataFrame, probs: tuple[float, ...] = (0.90, 0.95, 0.99)
) -> DataFrame:
    """Share of the targeted papers at or above a venue's tweet quantile, among papers with any tweet."""
    hist = (
        features.filter(F.col("tweet_count") > 0)
        .select("id", "tweet_count")
        .join(cohort.select("id", "venue", "type"), "id")
        .groupBy("venue", "type", "tweet_count")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cuts = hist.groupBy("venue").agg(
        F.percentile("tweet_count", F.array(*[F.lit(p) for p in probs]), F.col("n")).alias("_cuts")
    )
    hits = (
        hist.filter(F.col("type") == "letter")
        .join(cuts, "venue")
        .groupBy("venue", "type")
        .agg(
            *[
                (F.sum(F.when(F.col("tweet_count") >= F.col("_cuts")[i], F.col("n")).otherwise(0)) / F.sum("n")).alias(
                    f"top_{round((1 - p) * 100):02d}pct"
                )
                for i, p in enumerate(probs)
            ]
        )
    )
    names = [f"top_{round((1 - p) * 100):02d}pct" for p in probs]
    return hits.unpivot(["venue", "type"], names, "metric", "prop_hit").withColumn("prop_hit", F.round("prop_hit", 3))


def attention_share(matched: DataFrame, features: DataFrame) -> DataFrame:
    """Share of papers with at least one tweet, and with at least one news mention, per venue and arm."""
    joined = matched.select("id", "venue", "type").join(
        features.select("id", "tweet_count", "newsfeed_count"), "id", "left"
    )
    share = lambda c: F.count_if(F.col(c) > 0) / F.count(F.lit(1))
    return (
        joined.groupBy("venue", "type")
        .agg(share("tweet_count").alias("has_tweet"), share("newsfeed_count").alias("has_news"))
        .unpivot(["venue", "type"], ["has_tweet", "has_news"], "metric", "prop")
    )


def attention_crosstab(letters: DataFrame, features: DataFrame, metric: str, breaks, labels) -> DataFrame:
    """Original bucket by letter bucket with the share inside the original's bucket.

    The denominator includes pairs whose letter falls outside the buckets; those rows are dropped afterwards.
    """
    scores = features.select("id", F.col(metric).alias("_v"))
    orig = scores.select(F.col("id").alias("original_id"), F.col("_v").alias("_o"))
    lett = scores.select(F.col("id").alias("letter_id"), F.col("_v").alias("_l"))
    counts = (
        letters.select("original_id", "letter_id")
        .join(orig, "original_id", "left")
        .join(lett, "letter_id", "left")
        .groupBy(
            edge_label(F.col("_o"), breaks, labels).alias("original_bucket"),
            edge_label(F.col("_l"), breaks, labels).alias("letter_bucket"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("original_bucket").agg(F.sum("count").alias("_total"))
    return (
        null_safe_join(counts, totals, ["original_bucket"], "inner")
        .filter(F.col("original_bucket").isNotNull() & F.col("letter_bucket").isNotNull())
        .select("original_bucket", "letter_bucket", "count", (F.col("count") / F.col("_total")).alias("prop"))
    )
