"""Line dedup: overlapping windows of three lines that occur again are cut where they occur later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.session import cut_lineage


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, text, n_lines, n_removed, with later occurrences of repeated windows removed.

    Lines end at newline characters. Every `width` consecutive lines of a text form a window; windows of blank lines
    only do not count. The occurrence with the smallest (doc_id, position) stays; the lines of all others are merged
    and removed. Texts of fewer lines stay as they are, a NULL text stays NULL with 0 lines, and NULL ids sort first.
    Rows equal in id and text count as one document and are all kept; of rows with one id and several texts, the order
    follows the hash of the text. Other columns are ignored. An empty table gives no rows.
    """
    lines = F.split("text", "\n", -1)
    own = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    window = F.concat_ws("\n", *[F.expr(f"lines[i + {k}]") for k in range(width)])
    windows = (
        own.withColumn("lines", lines)
        .where(F.size("lines") >= width)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.size("lines") - width)))
        .select("doc_id", "row_key", "i", window.alias("w"))
        .where(F.col("w").rlike(r"[^\s]"))
        .select("doc_id", "row_key", "i", F.unhex(F.md5("w")).alias("print"))
    )
    windows = cut_lineage(windows)
    place = F.struct("doc_id", "row_key", "i")
    first = windows.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = windows.join(first, "print").where(place != F.col("first")).select("row_key", "i")
    starts = later.groupBy("row_key").agg(F.collect_set("i").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + width - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    # A sort-merge join at every size: the starts grow with the corpus.
    out = own.join(cut_lineage(starts).hint("merge"), "row_key", "left").withColumn("lines", lines)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return out.select(
        "doc_id",
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(rest).alias("text"),
        n.cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_removed"),
    )
