"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, several buckets a table, verified pairs.

1. Equal vectors of a label become one (`kinds`), with the number of its copies.
2. Each is rotated by three sign flips and Hadamard transforms for every hash; the nearest corner of the cross-polytope
   is its hash, two or more hashes make the bucket of a table. Besides its own bucket it enters the buckets whose
   corners are next nearest (multiprobe).
3. Buckets are cut into chunks, and pairs of chunks into tiles of bounded size. A tile computes its cosines as one
   matrix product in double precision. A pair that shares several buckets counts in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.llm.arrow import keyed
from lettermark.llm.components import Forest, components
from lettermark.session import cut_lineage

#: A cosine from the matrix product that comes this near to the threshold is taken again by exactly rounded sums.
SLACK = 1e-12


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two, keeping its norm."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """Buckets of unit vectors as int64[rows, tables, probes]; the first probe is the own bucket."""
    wide = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, wide))
    rows = np.arange(len(x))[:, None]
    near = min(probes, 2 * wide)
    out = np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k in range(hashes):
            y = x
            for s in signs[t, k]:
                y = hadamard(y * s)
            corners = np.concatenate((y, -y), 1)
            top = np.argsort(-corners, axis=1, kind="stable")[:, :near]
            cost = (corners[rows, top[:, :1]] - corners[rows, top]) ** 2
            codes = (codes[:, :, None] * (2 * wide) + top[:, None, :]).reshape(len(x), -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            codes, costs = codes[rows, best], costs[rows, best]
        out[:, t] = codes
    return out


def unit_rows(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions and unit vectors, in double precision, of the rows that are neither NULL, zero nor without a finite norm."""
    at, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                at.append(i)
                rows.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), rows


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine from sums that are rounded once, the same for every order of the components."""
    xy, xx, yy = (math.fsum(p.tolist()) for p in (x * y, x * x, y * y))
    return xy / math.sqrt(xx * yy)


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which pairs of rows share no bucket before `code` of `table`; codes are [row, table, probe]."""
    fresh = np.ones(len(i), dtype=bool)
    for t in range(table + 1):
        for p in range(codes.shape[2]):
            some = np.flatnonzero(fresh)
            mine, theirs = codes[i[some], t, p], codes[j[some], t]
            shared = (mine[:, None] == theirs).any(1)
            fresh[some[shared if t < table else shared & (mine < code)]] = False
    return fresh


def _tile(tile: pa.Table, cosine: float, tables: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Rows with links, their numbers, and spanning links of one tile."""
    n = tile.num_rows
    table, code, ta, tb = (tile[c][0].as_py() for c in ("t", "code", "ta", "tb"))
    x = np.frombuffer(b"".join(tile["unit"].to_pylist()), np.float64).reshape(n, -1)
    codes = np.array(tile["codes"].to_pylist(), np.int64).reshape(n, tables, -1)
    copies, side = np.asarray(tile["copies"]), np.asarray(tile["chunk"])
    a, b = np.flatnonzero(side == ta), np.flatnonzero(side == tb)
    near = x[a] @ x[b].T
    if ta == tb:
        near = np.where(np.tri(len(a), dtype=bool), -2.0, near)
    i, j = np.nonzero(near >= cosine - SLACK)
    near, i, j = near[i, j], a[i], b[j]
    sure = near >= cosine + SLACK
    sure[~sure] = [exact_cosine(x[r], x[s]) >= cosine for r, s in zip(i[~sure], j[~sure], strict=True)]
    i, j = i[sure], j[sure]
    fresh = _first_shared(codes, i, j, table, code)
    i, j = i[fresh], j[fresh]
    counts = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    forest = Forest(n)
    links = [(r, s) for r, s in zip(i.tolist(), j.tolist(), strict=True) if forest.join(r, s)]
    some = np.flatnonzero(counts)
    return some, counts[some].astype(np.int64), links


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 8, probes: int = 4, hashes: int = 3, chunk: int = 128) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows link when their labels are equal and not NULL, their vectors have one length and their cosine reaches
    `cosine`. NULL, empty and zero vectors, and those with NULL or non-finite components, link with nothing. Copies of
    a vector link with each other and with all that any of them links with. Rows that repeat an id count as vectors of
    their own; a NULL id is never the smallest unless there is no other. Other columns are ignored; an empty table
    gives no rows.
    """
    kind = vectors.schema["label"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = unit_rows(batch.column(1))
            units: list[bytes | None] = [None] * batch.num_rows
            for i, x in zip(at.tolist(), rows, strict=True):
                units[i] = (x + 0.0).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    known = vectors.select("vec_id", "embedding", "label").mapInArrow(measure, f"vec_id long, label {kind}, unit binary")
    known = cut_lineage(known.withColumn("kind", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.unhex(F.md5(F.concat(F.col("unit"), F.encode(F.col("label").cast("string"), "UTF-8")))))))
    kinds = known.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                raw = own.column(3).to_pylist()
                lengths = np.array([len(r) for r in raw])
                codes = np.empty((len(raw), tables * probes), np.int64)
                for size in np.unique(lengths):
                    rows = np.flatnonzero(lengths == size)
                    codes[rows] = buckets(np.stack([np.frombuffer(raw[i], np.float64) for i in rows]), tables, hashes, probes).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=[*own.schema.names, "codes"])

    kinds = cut_lineage(kinds.select("kind", "copies", "label", "unit", "least").mapInArrow(enter, f"kind binary, copies long, label {kind}, unit binary, least long, codes array<long>"))
    place = ["label", "size", "t", "code"]
    entries = kinds.select("kind", "label", F.octet_length("unit").alias("size"), F.posexplode("codes").alias("at", "code"))
    entries = entries.select("kind", "label", "size", F.floor(F.col("at") / probes).cast("int").alias("t"), "code")
    counts = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counts = counts.select(*place, F.ceil(F.col("members") / chunk).cast("int").alias("k"))
    met = entries.join(counts, place).withColumn("chunk", F.pmod(F.xxhash64("kind"), F.col("k")).cast("int"))
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tile = [*place, "ta", "tb"]
    tiles = tiles.select(*place, F.least("chunk", "other").alias("ta"), F.greatest("chunk", "other").alias("tb"), "kind", "chunk")
    tiles = tiles.join(kinds.select("kind", "copies", "unit", "codes"), "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed(batches, tile):
            if part.num_rows < 2:
                continue
            some, number, links = _tile(part, cosine, tables)
            if len(some):
                names = part["kind"].to_pylist()
                a = [names[i] for i in some.tolist()] + [names[i] for i, _ in links]
                b = [None] * len(some) + [names[j] for _, j in links]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*number.tolist(), *[0] * len(links)], pa.int64())], names=["a", "b", "n"])

    found = cut_lineage(tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(compare, "a binary, b binary, n long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("kind")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "kind")
    named = kinds.select("kind", "copies", "least").join(roots, "kind", "left").withColumn("root", F.coalesce("root", "kind"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(links, "kind", "left")
    named = named.select("kind", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = known.select("vec_id", "kind").join(named, "kind", "left")
    component = F.when(F.col("kind").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
