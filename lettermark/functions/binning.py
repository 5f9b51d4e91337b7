"""Interval binning with right-closed edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_width_bin(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Split the observed range of `column` into `bins` equal right-closed intervals, numbered from 1."""
    ends = F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rng = df.agg(ends.alias("rng")).scalar()
    lo, width = rng["lo"], (rng["hi"] - rng["lo"]) / bins
    # rounding keeps a value that sits on an edge inside the lower interval on every engine
    raw = F.ceil(F.round(F.try_divide(F.col(column) - lo, width), 9)).cast("int")
    return df.withColumn(
        out, F.when(F.col(column).isNotNull(), F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(raw, F.lit(1)))))
    )


def edge_label(column: Column, breaks, labels) -> Column:
    """Right-closed buckets, lowest edge included; outside the edges or NULL gives NULL."""
    expr = None
    for hi, label in zip(breaks[1:], labels):
        expr = F.when(column <= hi, label) if expr is None else expr.when(column <= hi, label)
    return F.when(column >= breaks[0], expr)


def log_bins(scale: float, limit: int = 2**63) -> list[tuple[float, float, int]]:
    """Geometric bins as (low, high, power): `power` is the exponent whose edge closes the bin.

    The last bin closes beyond `limit`; the default covers every value of a long column.
    """
    if scale <= 1:
        raise ValueError("scale must exceed 1")
    edges: list[tuple[int, int]] = []
    for power in range(1, math.ceil(math.log(limit) / math.log(scale)) + 3):
        edge = int(scale**power)
        if not edges or edge != edges[-1][0]:
            edges.append((edge, power))
    mids = [
        (math.sqrt(a * (b - 1)), power) for (a, _), (b, power) in zip(edges, edges[1:])
    ]
    return [(lo, hi, power) for (lo, _), (hi, power) in zip(mids, mids[1:]) if hi > lo]
