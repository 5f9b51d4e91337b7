"""Connected components of an edge table by alternating star contractions, one written table per round.

Once at most FEW edges are left, one task of that bounded size finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.session import cut_lineage


#: Edges that one task may hold.
FEW = 100_000


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as the stars of its components: fewer rows, same components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.asarray(batch.column(k).to_pylist(), dtype=object) if pa.types.is_binary(batch.column(k).type) else np.asarray(batch.column(k)) for k in (0, 1))
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in zip(code[: len(a)].tolist(), code[len(a) :].tolist(), strict=True):
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(nodes))])
        own = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own].tolist(), batch.schema.types[0]), pa.array(nodes[roots[own]].tolist(), batch.schema.types[0])], names=["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges as the stars of their components."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _contract(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a smaller one in its component; root is the smallest node.

    `edges` has two columns of one orderable type. Loops, repeats and NULL ends are ignored; an empty table gives none.
    Each round sends every node's larger neighbours to its smallest neighbour, then its smaller ones, until nothing
    changes. The minima are aggregates with map-side combine; a hub's rows meet one aggregated row in a join that
    adaptive execution may split.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    edges = edges.mapInArrow(_contract, f"a {kind}, b {kind}").distinct()
    edges = cut_lineage(edges)
    seen = _mark(edges)
    while seen[0]:
        if seen[0] <= FEW:
            edges = cut_lineage(edges.coalesce(1).mapInArrow(_finish, f"a {kind}, b {kind}"))
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = cut_lineage(down.union(least.select("a", F.col("m").alias("b"))).distinct())
        seen, before = _mark(edges), seen
        if seen == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
