"""Exact Jaccard join of word n-gram sets: pigeonhole routing to small groups, then signature trees inside each group.

1. `shingle_sets` gives each document the size, a 128-bit fingerprint and a token bitmap of its set; equal sets become one.
2. `routed_groups`: sets are banded by size and cut by hash range into more parts than two linked sets of the band can
   differ in, so linked sets share whole parts. Sets that share a part form a group. In a large group every member is
   first compared with one of them; where that leaves one component nothing is left to do. Others are cut into tiles
   if they are large, and the largest are dealt anew by pairs of shared parts before (linked sets share at least two).
3. `surviving_clusters` builds a signature tree over each group (OR-combined bitmaps and size ranges) and walks pairs of
   nodes, leaving those whose largest possible overlap is too small. Groups that differ only in what falls away here
   leave the same clusters, which count once.
4. `linked_sets` compares whole sets: first every member of a cluster with the first one. Clusters with common members
   are then one; where its sets still lie in several components, the sets outside the largest component are compared
   with all others, in tiles, by the trees again and by whole sets.

Empty tables give empty results, NULL and wordless texts have an empty set and link with nothing. Rows may repeat ids or
texts, and ids may be NULL: the component of a row is the smallest id of any row whose set is reachable from its own.
Other columns of the table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.llm.arrow import LOWER, NOT_SPACE, hash_spans, keyed, mix, runs, slices, text_bytes
from lettermark.llm.components import Forest, components
from lettermark.session import cut_lineage

#: Most bits of a bitmap, members of a leaf, children of an inner node.
MOST_BITS, LEAF, FANOUT = 1 << 18, 8, 4
#: Members of a group that are compared by its tree at once; larger groups are compared with one of their members first.
FEW = 16
#: Chunks of a group whose pairs are tiles; a larger group is dealt anew.
CHUNKS = 32
#: Pairs of nodes expanded at once, and pairs of a tile beyond which overlaps come from one matrix product.
BLOCK, MANY = 2048, 2000
#: Sets whose copies a task recognises, so that it routes them once.
RECENT = 100_000
#: Bits of the bitmap of wanted texts, 1 MB that every executor gets.
SLOTS = 1 << 23


def sets_of(column, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; texts with fewer words give the whole sequence as one n-gram."""
    offsets, data = text_bytes(column)
    for a, b in slices(offsets):
        own, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = runs(NOT_SPACE[own], at)
        h = hash_spans(own, starts, ends)
        first = np.searchsorted(starts, at)
        gram = h.copy()
        for k in range(1, words):
            gram[: len(h) - k] = mix(gram[: len(h) - k] * np.uint64(3) + h[k:])
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = j - i
            if n >= words:
                one = np.sort(gram[i : j - words + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            elif n:
                whole = np.array([n], np.uint64)
                for k in range(i, j):
                    whole = mix(whole * np.uint64(3) + h[k])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(one: np.ndarray) -> bytes:
    return blake2b(one.tobytes(), digest_size=16).digest()


def bitmap(one: np.ndarray, each: int = 4) -> bytes:
    """One bit for each n-gram, by its low bits; the width is a power of two of at least `each` bits an n-gram."""
    width = 64
    while width < min(each * len(one), MOST_BITS):
        width *= 2
    bits = np.zeros(width, dtype=bool)
    bits[(one & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Scheme:
    """Size bands and their parts for the threshold `percent`.

    Band k starts at `bounds[k]`; a set links only with sets of its own band and its neighbours. Linked sets of bands
    k and k, or k and k + 1, differ in at most `differ[k]` n-grams, and there are `spare[k]` parts more than that: three,
    and twice as many as the band's smallest sets leave without n-grams on average.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds, self.differ, self.spare, self.cuts = [1], [], [], []

    def band(self, n: int) -> int:
        p, bounds = self.percent, self.bounds
        while bounds[-1] <= n:
            low = bounds[-1]
            bounds.append(100 * low // p + 1)
            most = bounds[-1] - 1
            self.differ.append((100 - p) * (most + 100 * most // p) // (100 + p))
            parts = self.differ[-1] + 3
            self.spare.append(3 + int(2 * parts * math.exp(-low / parts)))
            parts = self.differ[-1] + self.spare[-1]
            self.cuts.append(np.array([-(-(j << 64) // parts) for j in range(1, parts)], np.uint64))
        k = int(np.searchsorted(bounds, n, "right")) - 1
        return k

    def keys(self, one: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
        """Routing keys of one set for each of its bands, in the order of the parts, and whether the band is its own.

        Linked sets share the spare parts at least. Parts without n-grams, which chance sets share as well, count only
        in a set that has more of them than the spare parts but two: then linked sets share two parts that count.
        """
        n = len(one)
        if not n:
            return
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one)))
        k = self.band(n)
        for band in (k - 1, k):
            if band < 0 or not self.differ[band]:
                continue
            at = np.concatenate(([0], np.searchsorted(one, self.cuts[band]), [n]))
            sums = running[at[1:]] - running[at[:-1]]
            filled = at[1:] > at[:-1]
            salt = np.arange(band << 20, (band << 20) + len(sums), dtype=np.uint64)
            salted = mix(sums + mix(salt))
            yield band == k, salted if len(filled) - filled.sum() > self.spare[band] - 2 else salted[filled]


def shingle_sets(docs: DataFrame, words: int = 3, each: int = 4) -> DataFrame:
    """(doc_id, row_key, n, fp, bits): size, fingerprint and bitmap of each row's set; row_key hashes the text."""

    def measure(batches):
        for batch in batches:
            sizes, prints, bits = [], [], []
            for one in sets_of(batch.column(2), words):
                sizes.append(len(one))
                prints.append(fingerprint(one) if len(one) else None)
                bits.append(bitmap(one, each) if len(one) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "row_key", "n", "fp", "bits"])

    keyed_docs = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    return keyed_docs.mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, n long, fp binary, bits binary")


def short(fp: str):
    """The first eight bytes of a fingerprint as a number."""
    return F.conv(F.hex(F.substring(fp, 1, 8)), 16, -10).cast("long")


def _entries(keys: list[np.ndarray], nodes: list[tuple[int, bool]]) -> pa.RecordBatch:
    key, sizes = np.concatenate(keys).view(np.int64), [len(k) for k in keys]
    node, own = (np.repeat(np.array(c), sizes) for c in zip(*nodes, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node, pa.int64()), pa.array(own, pa.bool_())], names=["key", "node", "own"])


def _node(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "big", signed=True)


def _group(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(key, members, hot) from rows (key, node, own) sorted by key and node: keys with two to `most` different nodes in
    one row each, keys with more as hot rows of some of their nodes. No key is held whole.

    A group of which no set is in its own band is left out: its pairs meet in their own band.
    """
    held_key, held, held_own, hot_key = 0, np.zeros(0, np.int64), np.zeros(0, bool), None

    def rows(keys, starts, nodes, own, hot):
        if not len(starts):
            return
        sizes = np.diff(np.append(starts, len(nodes)))
        good = hot | ((sizes > 1) & np.logical_or.reduceat(own, starts))
        some = np.flatnonzero(good)
        if len(some):
            offsets = np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32)
            members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes[np.repeat(good, sizes)]))
            lows = np.add.reduceat(own.astype(np.int64), starts)[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[some]]), members, pa.array(hot[some]), pa.array(lows > 0)], names=["key", "members", "hot", "own"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.concatenate((np.full(len(held), held_key, np.int64), np.asarray(batch.column(0))))
        n = np.concatenate((held, np.asarray(batch.column(1))))
        o = np.concatenate((held_own, np.asarray(batch.column(2))))
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
        k, n, o = k[fresh], n[fresh], o[fresh]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        last = int(starts[-1])
        hot = (np.diff(starts) > most) | (k[starts[:-1]] == hot_key if hot_key is not None else False)
        yield from rows(k[:last], starts[:-1], n[:last], o[:last], hot)
        held_key, held, held_own = int(k[-1]), n[last:], o[last:]
        if len(held) > most:
            hot_key = held_key
            yield from rows(k[last:], np.zeros(1, np.int64), held, held_own, np.ones(1, dtype=bool))
            held, held_own = held[-1:], held_own[-1:]
    if len(held):
        yield from rows(np.full(len(held), held_key, np.int64), np.zeros(1, np.int64), held, held_own, np.array([held_key == hot_key]))


def _grouped(entries: DataFrame, most: int) -> DataFrame:
    spread = entries.repartition("key").sortWithinPartitions("key", "node")
    return cut_lineage(spread.mapInArrow(lambda batches: _group(batches, most), "key long, members array<long>, hot boolean, own boolean"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc_id, row_key, fp, ...) with the text of its row, rows of one fp next to each other.

    A bitmap of `SLOTS` bits keeps most other texts from being dealt out: it lets every wanted row pass, and a few more.
    """
    wanted = cut_lineage(wanted)
    slot, place = F.pmod("row_key", F.lit(SLOTS)), F.bitmap_bit_position("slot")
    marks = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("marks"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").withColumn("slot", slot).withColumn("bucket", F.bitmap_bucket_number("slot"))
    byte = F.conv(F.hex(F.expr("substring(marks, CAST(bitmap_bit_position(slot) DIV 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    texts = texts.join(F.broadcast(marks), "bucket").where(bit).select("doc_id", "row_key", "text").alias("d")
    columns = [f"w.{c}" for c in wanted.columns if c not in ("doc_id", "row_key")]
    return texts.join(wanted.hint("merge").alias("w"), F.expr("d.row_key = w.row_key AND d.doc_id <=> w.doc_id")).select(*columns, "d.text")


def _open(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, node) of large groups whose members lie in several components of `roots` (node, root)."""
    named = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.hex("node")))
    keys = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    return cut_lineage(large.join(keys.where("low != high").select("key", "size"), "key"))


def _large(groups: DataFrame) -> DataFrame:
    """The rows (key, node) of hot keys with a set in its own band."""
    hot = groups.where("hot")
    own = hot.where("own").select("key").distinct()
    return cut_lineage(hot.join(own, "key").select("key", F.explode("members").alias("node")).distinct())


def routed_groups(docs: DataFrame, kinds: DataFrame, words: int, percent: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(groups, linked): groups (gid, ta, tb, node, chunk) of sets such that any two linked sets meet in one or are of
    one component of `linked` (node, root), the links found on the way, if any.

    A group has one tile (0, 0) with all members, or more where it exceeds `most` members even by two shared parts:
    then each pair of its chunks is a tile.
    """

    def route(batches):
        scheme, seen = Scheme(percent), set()
        for batch in batches:
            keys, nodes, total = [], [], 0
            for one in sets_of(batch.column(0), words):
                node = _node(fingerprint(one))
                if node in seen:
                    continue
                if len(seen) >= RECENT:
                    seen.clear()
                seen.add(node)
                for own, k in scheme.keys(one):
                    keys.append(k)
                    nodes.append((node, own))
                    total += len(k)
                if total > 500_000:
                    yield _entries(keys, nodes)
                    keys, nodes, total = [], [], 0
            if total:
                yield _entries(keys, nodes)

    groups = _grouped(docs.select("text").mapInArrow(route, "key long, node long, own boolean"), FEW)
    found, linked, tiles = groups.where("NOT hot").select("members"), None, None
    large = _large(groups)
    if not large.isEmpty():
        named = kinds.select("fp", short("fp").alias("node"))
        rows = large.join(named, "node").select("key", "fp")
        stars = rows.join(rows.groupBy("key").agg(F.min("fp").alias("hub")), "key").where("fp != hub").select("hub", "fp").distinct()
        near = cut_lineage(_compared(stars, kinds.select("fp", "n", "bits"), percent))
        sets = whole_sets(docs, kinds, near.select(F.col("a").alias("fp")).union(near.select("b")), words)
        links = cut_lineage(_compared(near.toDF("hub", "fp"), sets.select("fp", "n", "grams"), percent))
        linked = components(links)
        roots = linked.select(short("node").alias("node"), F.hex("root").alias("root"))
        roots = roots.unionAll(roots.select(F.conv(F.substring("root", 1, 16), 16, -10).cast("long").alias("node"), "root").distinct())
        large = _open(large, roots)
        tiles = large.where(F.col("size") <= CHUNKS * most)
        hot = cut_lineage(large.where(F.col("size") > CHUNKS * most).groupBy("node").agg(F.collect_list("key").alias("keys")))

        def refine(batches):
            scheme, last = Scheme(percent), None
            for batch in batches:
                keys, nodes, total = [], [], 0
                for one, fp, wanted in zip(sets_of(batch.column("text"), words), batch.column("fp").to_pylist(), batch.column("keys"), strict=True):
                    if last == (last := fp) or fingerprint(one) != fp:
                        continue
                    wanted = np.asarray(wanted.values).view(np.uint64)
                    for own, k in scheme.keys(one):
                        for i in np.flatnonzero(np.isin(k[:-1], wanted)).tolist():
                            keys.append(mix(k[i] * np.uint64(3) + k[i + 1 :]))
                            nodes.append((_node(fp), own))
                            total += len(keys[-1])
                    if total > 500_000:
                        yield _entries(keys, nodes)
                        keys, nodes, total = [], [], 0
                if total:
                    yield _entries(keys, nodes)

        place = kinds.select("doc_id", "row_key", "fp", short("fp").alias("node")).join(hot, "node").select("doc_id", "row_key", "fp", "keys")
        if not hot.isEmpty():
            again = _grouped(_texts(docs, place).mapInArrow(refine, "key long, node long, own boolean"), FEW)
            found = found.unionAll(again.where("NOT hot").select("members"))
            tiles = tiles.unionAll(_open(_large(again), roots))
    found = found.distinct().withColumn("gid", F.xxhash64("members"))
    zero = F.lit(0).alias
    small = found.select("gid", zero("ta"), zero("tb"), F.explode("members").alias("node"), zero("chunk"))
    if tiles is None:
        return small, linked
    dealt = tiles.withColumn("k", F.ceil(F.col("size") / most).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(F.col("key").alias("gid"), F.least("chunk", "other").alias("ta"), F.greatest("chunk", "other").alias("tb"), "node", "chunk")
    return small.unionAll(dealt), linked


def folded(bitmaps: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as uint64 rows of the least width among them, wider ones folded onto it."""
    width = width or min(map(len, bitmaps))
    rows = []
    for b in bitmaps:
        row = np.frombuffer(b, np.uint64)
        while 8 * len(row) > width:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


class SignatureTree:
    """Levels of nodes over sets sorted by size; level 0 is the sets, the last level the root.

    A node holds the OR of its sets' bitmaps, its least and largest size, and the most n-grams a set of it loses to
    bits hit twice. Two sets share at most the common bits plus the smaller such loss.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(1).astype(np.int64))]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))
            width = FANOUT

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the parent and child for every child of the nodes."""
        width = LEAF if level == 1 else FANOUT
        child = nodes[:, None] * width + np.arange(width)
        parent = np.broadcast_to(np.arange(len(nodes))[:, None], child.shape)
        fits = child < len(self.levels[level - 1][1])
        return parent[fits], child[fits]


def surviving_pairs(one: SignatureTree, two: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the dual walk cannot rule out, some at a time."""
    i, j = len(one.levels) - 1, len(two.levels) - 1
    todo = [(i, j, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        i, j, p, q = todo.pop()
        (ma, la, ha, xa), (mb, lb, hb, xb) = one.levels[i], two.levels[j]
        fits = (100 * ha[p] >= percent * lb[q]) & (100 * hb[q] >= percent * la[p])
        p, q = p[fits], q[fits]
        common = np.bitwise_count(ma[p] & mb[q]).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(ha[p], hb[q]), common + np.minimum(xa[p], xb[q]))
        fits = (100 + percent) * most >= percent * (la[p] + lb[q])
        p, q = p[fits], q[fits]
        if not len(p):
            continue
        if i == j == 0:
            # Each bit that only one of two sets has stands for an n-gram that only one of them has.
            alone = np.bitwise_count(ma[p] ^ mb[q]).sum(1).astype(np.int64)
            fits = (100 + percent) * (la[p] + lb[q] - alone) >= 2 * percent * (la[p] + lb[q])
            yield p[fits], q[fits]
            continue
        for k in range(0, len(p), BLOCK):
            if i >= j:
                parent, child = one.children(i, p[k : k + BLOCK])
                todo.append((i - 1, j, child, q[k : k + BLOCK][parent]))
            else:
                parent, child = two.children(j, q[k : k + BLOCK])
                todo.append((i, j - 1, p[k : k + BLOCK][parent], child))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def candidate_pairs(sizes: np.ndarray, bitmaps: list[bytes], root: list, side: np.ndarray, mixed: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different roots that the trees leave: within all rows, or between the two sides if `mixed`."""
    order, maps = np.argsort(sizes, kind="stable"), folded(bitmaps)
    names: dict = {}
    root = np.array([names.setdefault(r, len(names)) for r in root])
    if mixed:
        sides = np.unique(side)
        if len(sides) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = order[side[order] == sides[0]], order[side[order] == sides[-1]]
        one, two = SignatureTree(maps[a], sizes[a]), SignatureTree(maps[b], sizes[b])
    else:
        a = b = order
        one = two = SignatureTree(maps[order], sizes[order])
    found = [np.zeros((2, 0), np.int64)]
    for p, q in surviving_pairs(one, two, percent):
        keep = (mixed | (p < q)) & (root[a[p]] != root[b[q]])
        found.append(np.stack((a[p[keep]], b[q[keep]])))
    p, q = np.concatenate(found, 1)
    return p, q


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n rows that the pairs connect."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if (label == before).all():
            return label


def overlaps(grams: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Common n-grams of the pairs of rows; many pairs by matrix products over some n-grams at a time."""
    if len(p) <= MANY:
        return np.array([_overlap(grams[i], grams[j]) for i, j in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, code, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    total = np.zeros((len(grams), len(grams)), np.float32)
    width = 4096
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        part = np.zeros((len(grams), width), np.float32)
        part[row[a:b], code[a:b] - low] = 1
        total += part @ part.T
    return total[p, q].astype(np.int64)


def _pair_fits(m: int, n: int, a: bytes, b: bytes, percent: int) -> bool:
    """The tree's tests for two sets alone."""
    if len(a) != len(b):
        a, b = (r.tobytes() for r in folded([a, b]))
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    most = min(m, n, (x & y).bit_count() + min(m - x.bit_count(), n - y.bit_count()))
    return (100 + percent) * min(2 * most, m + n - (x ^ y).bit_count()) >= 2 * percent * (m + n)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (hub, fp) that link, by whole sets (fp, n, grams), or that may link, by bitmaps (fp, n, bits).

    The partners of a hub are dealt to several tasks, each with the hub's own row first.
    """
    column = sets.columns[2]
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(64)).cast("int"))
    rows = dealt.select("hub", "part", "fp").unionAll(dealt.select("hub", "part", F.col("hub").alias("fp")).distinct())
    rows = rows.join(sets, "fp").select("hub", "part", (F.col("fp") != F.col("hub")).alias("later"), "fp", "n", column)

    def test(batches):
        last, size, one = None, 0, b""
        for batch in batches:
            a, b = [], []
            for hub, part, fp, n, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "fp", "n", column)), strict=True):
                if fp == hub:
                    last, size, one = (hub, part), n, raw
                elif last == (hub, part):
                    if column == "bits":
                        fits = _pair_fits(size, n, one, raw, percent)
                    else:
                        shared = _overlap(np.frombuffer(one, np.uint64), np.frombuffer(raw, np.uint64))
                        fits = 100 * shared >= percent * (size + n - shared)
                    if fits:
                        a.append(hub)
                        b.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "later").mapInArrow(test, "a binary, b binary")


def whole_sets(docs: DataFrame, kinds: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, n, bits, grams) of the wanted fingerprints (fp), as a written table."""

    def fetch(batches):
        last = None
        for batch in batches:
            keep, grams = [], []
            for i, (one, fp) in enumerate(zip(sets_of(batch.column("text"), words), batch.column("fp").to_pylist(), strict=True)):
                if last != fp and fingerprint(one) == fp:
                    keep.append(i)
                    grams.append(one.tobytes())
                    last = fp
            out = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(grams, pa.binary())], names=[*out.schema.names, "grams"])

    rows = kinds.join(wanted.distinct(), "fp", "left_semi").select("doc_id", "row_key", "fp", "n", "bits")
    return cut_lineage(_texts(docs, rows).mapInArrow(fetch, "fp binary, n long, bits binary, grams binary"))


def surviving_clusters(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(members): sets of different components joined by pairs that the trees leave, each list of members once.

    `nodes` (node, fp, n, bits, root) describes the sets.
    """

    def prune(batches):
        for tile in keyed(batches, ["gid", "ta", "tb"]):
            fp, bits, root, sizes = (tile[c].to_pylist() for c in ("fp", "bits", "root", "n"))
            if len(set(root)) < 2:
                continue
            mixed = tile["ta"][0].as_py() != tile["tb"][0].as_py()
            if len(fp) == 2 and not mixed:
                out = [sorted(fp)] if _pair_fits(*sizes, *bits, percent) else []
            else:
                p, q = candidate_pairs(np.asarray(tile["n"]), bits, root, np.asarray(tile["chunk"]), mixed, percent)
                lists: dict[int, set] = {}
                for i, k in enumerate(joined(len(fp), p, q).tolist()):
                    lists.setdefault(k, set()).add(fp[i])
                out = [sorted(m) for m in lists.values() if len(m) > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["members"])

    met = groups.join(nodes, "node").select("gid", "ta", "tb", "chunk", "fp", "n", "bits", "root")
    met = met.repartition("gid", "ta", "tb").sortWithinPartitions("gid", "ta", "tb")
    lists = met.mapInArrow(prune, "members array<binary>").distinct()
    return cut_lineage(lists)


def linked_sets(docs: DataFrame, sets: DataFrame, words: int = 3, percent: int = 90, most: int = 2048, chunk: int = 512) -> DataFrame:
    """(a, b) fingerprints of linked sets, enough to span every component of the link graph."""
    kinds = sets.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "row_key")).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    kinds = cut_lineage(kinds.select("fp", "one.*", "n", "bits"))
    groups, linked = routed_groups(docs, kinds, words, percent, most)

    def rooted(rows: DataFrame, linked: DataFrame | None) -> DataFrame:
        """`rows` (fp, ...) with their component."""
        if linked is None:
            return rows.withColumn("root", F.col("fp"))
        return rows.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    nodes = rooted(kinds.select(short("fp").alias("node"), "fp", "n", "bits"), linked)
    clusters = surviving_clusters(groups, nodes, percent)
    whole = whole_sets(docs, kinds, clusters.select(F.explode("members").alias("fp")), words)
    exact = whole.select("fp", "n", "grams")
    stars = cut_lineage(clusters.select(F.get("members", 0).alias("hub"), F.explode(F.slice("members", 2, F.size("members"))).alias("fp")).distinct())
    links = cut_lineage(_compared(stars, exact, percent))  # a stage with two Python functions needs two workers a core
    linked = components(links if linked is None else linked.toDF("a", "b").unionAll(links))

    # Clusters with common members are one; its sets outside the largest component are compared with all others.
    joint = components(stars).withColumnsRenamed({"node": "fp", "root": "cid"})
    joint = cut_lineage(joint.unionAll(joint.select("cid", "cid").distinct()))
    named = cut_lineage(rooted(joint, linked))
    parts = named.groupBy("cid", "root").agg(F.count(F.lit(1)).alias("size"))
    sums = parts.groupBy("cid").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("of")).where(F.col("of") > F.col("top.size"))
    some = F.ceil((F.col("of") - F.col("top.size")) / chunk).cast("int")
    sums = sums.select("cid", F.col("top.root").alias("top"), some.alias("few"), F.ceil(F.col("top.size") / chunk).cast("int").alias("many"))
    rest = named.join(sums, "cid")
    major, hashed = F.col("root") == F.col("top"), F.xxhash64("fp")
    rest = rest.withColumn("chunk", F.when(major, F.col("few") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int"))
    met = F.when(major, F.col("few")).otherwise(F.col("few") + F.col("many"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    rest = rest.select("cid", F.least("chunk", "other").alias("ta"), F.greatest("chunk", "other").alias("tb"), "chunk", "root", "fp").join(whole, "fp")

    def across(batches):
        for tile in keyed(batches, ["cid", "ta", "tb"]):
            sizes, fp, root = np.asarray(tile["n"]), tile["fp"].to_pylist(), tile["root"].to_pylist()
            mixed = tile["ta"][0].as_py() != tile["tb"][0].as_py()
            p, q = candidate_pairs(sizes, tile["bits"].to_pylist(), root, np.asarray(tile["chunk"]), mixed, percent)
            if len(p):
                shared = overlaps([np.frombuffer(g, np.uint64) for g in tile["grams"].to_pylist()], p, q)
                fits = 100 * shared >= percent * (sizes[p] + sizes[q] - shared)
                label = joined(len(fp), p[fits], q[fits])
                out = np.flatnonzero(label != np.arange(len(fp))).tolist()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([fp[i] for i in out], pa.binary()), pa.array([fp[k] for k in label[out].tolist()], pa.binary())], names=["a", "b"])

    rest = rest.select("cid", "ta", "tb", "chunk", "root", "fp", "n", "bits", "grams")
    more = rest.repartition("cid", "ta", "tb").sortWithinPartitions("cid", "ta", "tb").mapInArrow(across, "a binary, b binary")
    return linked.toDF("a", "b").unionAll(cut_lineage(more))


def ngram_groups(docs: DataFrame, words: int = 3, percent: int = 90, each: int = 4) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, row_key, n, root, component_id; root is NULL for empty sets.

    `each` bits of a bitmap an n-gram: fewer take less disk, more rule out more pairs before whole sets are compared.
    """
    sets = cut_lineage(shingle_sets(docs, words, each))
    roots = cut_lineage(components(linked_sets(docs, sets, words, percent)))
    sets = sets.drop("bits")
    classes = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "root", "component_id")
    out = sets.join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_key", "n", "root", component.alias("component_id"))


def ngram_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    Two rows link when 100 * |A and B| >= percent * |A or B|.
    """
    return ngram_groups(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _fresh(name: str, columns: list[str]) -> str:
    """A column name that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of each group of linked texts, with all their columns.

    Of rows with that id the one whose text hashes least stays, of rows equal in id and text one, whichever. Texts
    without words belong to no group and stay. Rows are told apart by 128 bits of their id and text.
    """
    # Longer n-grams at a lower threshold share parts more often by chance: small bitmaps, as they travel with each group.
    groups = ngram_groups(docs, words, percent, each=2)
    first = groups.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("one")).select("one.*")
    keep = cut_lineage(first.union(groups.where("n = 0").select("doc_id", "row_key")).distinct())
    name = _fresh("row", docs.columns)
    text = F.coalesce(F.md5("text"), F.lit("none"))
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    print_ = F.unhex(F.md5(F.concat(known, F.lit(":"), text)))
    # Join and distinct rows share plain columns, so that the texts are dealt out once for both.
    on = [_fresh(c, docs.columns) for c in ("row_key", "id_text", "id_null")]
    marks = dict(zip(on, (F.xxhash64("text"), known, F.col("doc_id").isNull()), strict=True))
    keys = keep.select(F.col("row_key").alias(on[0]), known.alias(on[1]), F.col("doc_id").isNull().alias(on[2]))
    kept = docs.withColumns({**marks, name: print_}).join(keys, on, "left_semi")
    return kept.dropDuplicates([*on, name]).select(*[F.col(f"`{c}`") for c in docs.columns])
