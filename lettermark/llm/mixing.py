"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lettermark.llm.arrow import NOT_SPACE, runs, slices, text_bytes
from lettermark.llm.prefix import running_total
from lettermark.session import cut_lineage


def _count_words(batches):
    for batch in batches:
        offsets, data = text_bytes(batch.column(batch.num_columns - 1))
        counts = []
        for a, b in slices(offsets):
            at = offsets[a : b + 1] - offsets[a]
            starts, _ = runs(NOT_SPACE[data[offsets[a] : offsets[b]]], at)
            counts.append(np.diff(np.searchsorted(starts, at)))
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64())], names=[*batch.schema.names[:-1], "size"])


def _add_sizes(batches, place: int):
    for batch in batches:
        counted = next(_count_words([batch.select([place])]))
        yield pa.RecordBatch.from_arrays([*batch.columns, counted.column(0)], names=[*batch.schema.names, "size"])


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and `size`, the number of words of `text` (NULL: 0)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_count_words, f"{schema}, size long")


def _shuffled(doc_id: str = "doc_id") -> Column:
    """The place of a document in the shuffle of its source."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def source_order() -> list[Column]:
    """Sources by code point, NULL last."""
    return [F.col("source").isNull(), F.col("source")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[DataFrame, float]:
    """(source, source_size, target) and the budget, with `percent` of all sizes shared by weight and no target above `most` times its size.

    The weights repeat over the sources in code point order. The level of the water is found from running totals in
    the order in which sources fill up.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running_total(totals, source_order(), {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filled = running_total(ranked, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")})
    words, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (words or 0) * percent / 100
    left = F.lit(float(budget)) - (F.col("caps") - F.col("cap"))
    free = F.lit(all_weights) - (F.col("weights") - F.col("weight"))
    placed = filled.withColumn("fits", left * F.col("weight") <= F.col("cap") * free).withColumn("level", left / free)
    water = placed.where("fits").agg(F.max("level")).first()[0]
    target = F.when(F.col("fits"), F.lit(water) * F.col("weight")).otherwise(F.col("cap")).cast("double")
    return placed.select("source", "source_size", target.alias("target")), budget


def _readings(docs: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """Per row of `docs`: doc_id, source, row_key, shuffled, size, source_size, target and copies, as `fair_mix` has them."""
    docs = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("row_key"))
    sizes = cut_lineage(word_counts(docs, "doc_id", "source", "row_key").withColumn("shuffled", _shuffled()))
    targets, budget = source_targets(sizes, weights, percent, most)
    targets = cut_lineage(targets)
    placed = running_total(sizes, [*source_order(), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("row_key")], {"upto": F.col("size")})
    starts = placed.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    known = targets.join(starts.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    known = F.broadcast(known) if _small(known) else known
    placed = placed.alias("p").join(known.alias("t"), F.expr("p.source <=> t.source"), "left").select("p.*", "t.source_size", "t.target", "t.start")
    placed = cut_lineage(placed)

    def finish_at(turn):
        return (F.col("source_size") * turn + F.col("upto") - F.col("start")) / F.nullif("target", F.lit(0.0))

    order = ["finish", "no_source", "source", "turn", "shuffled", "doc_id", "size"]
    turns = placed.where("size > 0 AND target > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    turns = turns.select(finish_at(F.col("turn")).alias("finish"), F.col("source").isNull().alias("no_source"), "source", "turn", "shuffled", "doc_id", "size", "upto")
    queued = running_total(turns, [F.col(c) for c in [*order, "upto"]], {"taken": F.col("size")})
    mark = queued.where(F.col("taken") <= F.lit(budget)).agg(F.max(F.struct(*order, "upto")).alias("mark")).first()["mark"]
    copies = F.lit(0)
    if mark is not None:
        kinds = dict(queued.dtypes)
        last = F.struct(*[F.lit(mark[c]).cast(kinds[c]).alias(c) for c in mark.asDict()])
        for k in range(most):
            own = {"finish": finish_at(F.lit(k)), "no_source": F.col("source").isNull(), "turn": F.lit(k)}
            here = F.struct(*[own.get(c, F.col(c)).alias(c) for c in mark.asDict()])
            copies = copies + F.when((F.col("size") > 0) & (F.col("target") > 0) & (here <= last), 1).otherwise(0)
    return placed.select("doc_id", "source", "row_key", "shuffled", "size", "source_size", "target", copies.alias("copies"))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Per row of `docs` (doc_id, source, text): doc_id, size, source_size, target, taken, copies, row_key.

    Documents are shuffled by the md5 of their id. The k-th reading of a document finishes at the virtual time
    (words of its source up to it, earlier readings included) / target; all readings are range-sorted by it and kept
    while their running total stays within the budget, so a source ends within a document of its target.
    Wordless and NULL texts have size 0 and are never taken; a NULL source is a source of its own, and NULL ids come
    first in the shuffle. Rows that repeat an id are read one after the other. An empty table gives no rows.
    """
    readings = _readings(docs, weights, percent, most)
    return readings.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row_key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """The rows of `docs` (doc_id, source, text, any others), each as often as the mix takes it; see `fair_mix`.

    Rows equal in id, source and text are all read as often as the one of them that is read most.
    """
    # The readings of one turn are a first part of their source's order: the last of them tells, without a join of the
    # texts, which rows they are.
    order = ["shuffled", "doc_id", "size", "row_key"]
    last = [F.max(F.when(F.col("copies") > k, F.struct(*order))).alias(f"last_{k}") for k in range(most)]
    ends = cut_lineage(_readings(docs, weights, percent, most).where("copies > 0").groupBy("source").agg(*last))
    ends = F.broadcast(ends) if _small(ends) else ends
    columns, rows = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    place = {c: columns.index(c) for c in ("doc_id", "source", "text")}
    sized = rows.mapInArrow(lambda batches: _add_sizes(batches, place["text"]), StructType([*rows.schema, StructField("size", LongType())]))
    key = F.xxhash64(*[f"c{place[c]}" for c in ("doc_id", "source", "text")])
    here = F.struct(_shuffled(f"c{place['doc_id']}").alias("shuffled"), F.col(f"c{place['doc_id']}").alias("doc_id"), "size", key.alias("row_key"))
    met = sized.where("size > 0").withColumn("here", here).join(ends, F.expr(f"c{place['source']} <=> source"))
    copies = sum((F.when(F.col("here") <= F.col(f"last_{k}"), 1).otherwise(0) for k in range(most)), F.lit(0))
    repeated = met.withColumn("copies", copies).where("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def _small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row a source is small enough to be sent to every executor."""
    return df.limit(most + 1).count() <= most
