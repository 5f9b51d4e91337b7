"""Suffix-array dedup: bytes of repeated strings are found by longest-previous-factor arrays and cut where they occur later.

A place is (doc_id, key, start). A window is a string of `length` bytes; a byte goes if a window over it also starts at
an earlier place, which is to say if the longest previous factor of the window's suffix reaches `length`.

1. Every window chooses an anchor, a stretch of `k` bytes in it, by its bytes alone (the least hash of its short
   stretches, taken modulo `w`), so equal windows choose equal anchors at equal offsets. Neighbouring windows share an
   anchor; they form a segment. Anchors that occur once in the corpus are dropped by an aggregate of their hashes.
2. Equal segments are one class. All windows of a later occurrence have an earlier one in the first.
3. The first occurrences of different segments of one anchor meet in one task: it sorts their suffixes (`length` bytes
   deep), takes the common prefixes of neighbours, and finds for every suffix the nearest ones before and after it in
   suffix order that start at a smaller place; the longer of the two common prefixes is its longest previous factor.
4. Anchors with more than `most` different segments are dealt anew by whole windows. In a bucket of equal windows the
   previous smaller place of every suffix but the first is in the bucket, so the first place of each window is enough.

Classes and windows are reduced by aggregates before any join. The joins are between scans and written tables, so that
adaptive execution can split a hot class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.llm.arrow import _BYTE, _powers_to, hash_spans, mix, slices, text_bytes
from lettermark.session import cut_lineage

#: Bits of a place inside a piece of text, and bytes of a piece: pieces stay in the processor's cache.
PLACE_BITS, PIECE = 20, 1 << 18


class Anchors:
    """Which `k` bytes anchor a window of `length` bytes.

    Of the `t`-byte stretches of the window the leftmost with the least hash counts, `t` being congruent to `k` modulo
    the number `w` of places an anchor can take; its offset modulo `w` is the anchor's. Long anchors are rare outside
    real repeats, and this choice keeps one in about `length / 4` places.
    """

    def __init__(self, length: int, k: int):
        if not 8 <= k <= length:
            raise ValueError("an anchor has 8 bytes at least and fits the window")
        self.length, self.k, self.w = length, k, length - k + 1
        self.t = 8 + (k - 8) % self.w

    def places(self, data: np.ndarray) -> np.ndarray:
        """Place of the anchor of the window at every place of `data`."""
        n = len(data) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        up, down = _powers_to(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        v = (total[self.t :] - total[: -self.t]) * down[: len(data) - self.t + 1]
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v &= np.uint64((1 << 64) - (1 << PLACE_BITS))
        v |= np.arange(len(v), dtype=np.uint64)
        width, span = self.length - self.t + 1, 1
        while 2 * span <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < width:
            v = np.minimum(v[: span - width], v[width - span :])
        at = np.arange(n)
        least = (v & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        return at + (least - at) % self.w

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in data, number of windows, anchor's hash, bytes' hash) of the segments of rows at `offsets`."""
        sizes = np.diff(offsets)
        rows = np.flatnonzero(sizes >= self.length)
        if not len(rows):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        anchor = self.places(data)
        edge = np.zeros(len(anchor) + 1, np.int64)
        edge[offsets[rows]] += 1
        edge[offsets[rows + 1] - self.length + 1] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        head = np.ones(len(anchor), dtype=bool)
        head[1:] = anchor[1:] != anchor[:-1]
        head[offsets[rows]] = True
        starts = np.flatnonzero(head & inside)
        row = rows[np.searchsorted(offsets[rows], starts, "right") - 1]
        ends = np.minimum(np.append(starts[1:], len(anchor)), offsets[row + 1] - self.length + 1)
        return row, starts, ends - starts, hash_spans(data, anchor[starts], anchor[starts] + self.k), hash_spans(data, starts, ends + self.length - 1)


def previous_factors(lcp: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of every suffix, in suffix order.

    `lcp[i]` is the common prefix of suffixes i and i + 1, `place` their places; one that is met twice is not its own
    factor. The nearest suffix with a smaller place is found on both sides by pointer jumping, which carries the least
    common prefix along.
    """
    best = np.zeros(len(place), np.int64)
    for where, common in ((place, lcp), (place[::-1], lcp[::-1])):
        n = len(where)
        least = np.append(where, np.iinfo(np.int64).min)  # the last one stands for "none": smaller than all
        to = np.append(np.arange(-1, n - 1), n)
        to[0] = n
        shared = np.append(np.concatenate(([0], common)), 0)[: n + 1]
        shared[n] = 0
        while True:
            far = np.flatnonzero(least[to[:n]] >= where)
            if not len(far):
                break
            via = to[far]
            shared[far] = np.minimum(shared[far], shared[via])
            to[far] = to[via]
        factor = np.where(to[:n] == n, 0, shared[:n])
        best = np.maximum(best, factor if where is place else factor[::-1])
    return best


def repeated_suffixes(data: np.ndarray, suffix: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of `data`, cut to `length` bytes, occur at a smaller place: those whose factor reaches `length`."""
    text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[suffix])
    order = np.argsort(text.view(f"S{length}").ravel(), kind="stable")
    text = text[order]
    differs = text[1:] != text[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), length)
    out = np.zeros(len(suffix), dtype=bool)
    out[order] = previous_factors(lcp, place[order]) >= length
    return out


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of the repeated windows among the segments (doc, key, at, bytes) of whole buckets."""
    raw = table["bytes"].to_pylist()
    doc, key, at = (np.asarray(table[c]) for c in ("doc", "key", "at"))
    sizes = np.array([len(b) for b in raw], np.int64)
    offsets, runs = np.concatenate(([0], np.cumsum(sizes))), sizes - length + 1
    segment = np.repeat(np.arange(len(raw)), runs)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = (at >> 8)[segment] + inner
    order = np.lexsort((start, key[segment], doc[segment]))
    new = np.zeros(len(order), np.int64)
    new[1:] = (np.diff(start[order]) != 0) | (np.diff(key[segment[order]]) != 0) | (np.diff(doc[segment[order]]) != 0)
    place = np.empty(len(segment), np.int64)
    place[order] = np.cumsum(new)
    gone = np.flatnonzero(repeated_suffixes(np.frombuffer(b"".join(raw), np.uint8), offsets[segment] + inner, place, length))
    fresh = np.ones(len(gone), dtype=bool)
    fresh[1:] = (np.diff(gone) != 1) | (np.diff(segment[gone]) != 0)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(gone)) - 1
    first = gone[heads]
    columns = [doc[segment[first]], key[segment[first]], start[first], start[gone[tails]] + length]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "key", "low", "high"])


def _buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole buckets, of `least` rows or a little more, from rows sorted by `h`."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        h = np.asarray(batch.column("h"))
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        if held and held[-1]["h"][-1].as_py() == h[0]:
            cuts = cuts[1:]
        last = 0
        for cut in cuts.tolist():
            if count + cut - last >= least:
                held.append(table.slice(last, cut - last))
                yield pa.concat_tables(held)
                held, count, last = [], 0, cut
        held.append(table.slice(last))
        count += table.num_rows - last
    if count:
        yield pa.concat_tables(held)


def anchored_segments(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(h, fp, doc, key, at) of every segment of `texts` (doc, key, text); at = 256 * start + number of windows."""

    def scan(batches):
        anchors = Anchors(length, k)
        for batch in batches:
            doc, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            offsets, data = text_bytes(batch.column(2))
            for a, b in slices(offsets, PIECE):
                whole = offsets[a : b + 1]
                for low in range(int(whole[0]), int(whole[-1]), PIECE):  # more than one piece only in a long text
                    high = int(whole[-1]) if b > a + 1 else min(low + PIECE + length - 1, int(whole[-1]))
                    own = whole if b > a + 1 else np.array([low, high])
                    row, start, windows, h, fp = anchors.segments(data[low:high], own - low)
                    at = (start + low - offsets[a + row]) * 256 + windows
                    columns = [h.view(np.int64), fp.view(np.int64), doc[a + row], key[a + row], at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "fp", "doc", "key", "at"])
                    if b > a + 1:
                        break

    return texts.mapInArrow(scan, "h long, fp long, doc long, key long, at long")


def _first(classes: DataFrame) -> DataFrame:
    """(h, fp, first, last): the first and last place of each class."""
    place = F.struct("doc", "key", "at")
    return classes.groupBy("h", "fp").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def _later(classes: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """(doc, key, low, high) covered by the occurrences of each class but the first."""
    again = first.where("first != last").select("h", "fp", "first")
    rows = classes.join(again, ["h", "fp"]).where(F.struct("doc", "key", "at") != F.col("first"))
    low = F.shiftright("at", 8)
    return rows.select("doc", "key", low.alias("low"), (low + F.col("at").bitwiseAND(255) + (length - 1)).alias("high"))


def repeated_spans(texts: DataFrame, length: int = 100, k: int = 64, most: int = 512) -> DataFrame:
    """(doc, key, low, high): spans of bytes of `texts` (doc, key, text) that occur earlier, possibly overlapping.

    Rows equal in (doc, key) are one document. `most` bounds the segments of an anchor that one task compares.
    """
    if length - k + 1 > 255:
        raise ValueError("an anchor is shared by 255 windows at most")
    segments = anchored_segments(texts, length, k)
    repeated = cut_lineage(segments.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    classes = cut_lineage(segments.join(repeated, "h"))
    first = cut_lineage(_first(classes))
    sizes = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = first.join(sizes, "h").select("h", "first.*", (F.col("n") > most).alias("hot"))
    wanted = mixed.groupBy("doc", "key").agg(F.collect_list(F.struct("h", "at", "hot")).alias("items"))

    def fetch(batches):
        last = None
        for batch in batches:
            docs, keys = np.asarray(batch.column("doc")), np.asarray(batch.column("key"))
            offsets, data = text_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                if last == (last := (int(docs[i]), int(keys[i]))):
                    continue  # a repeated row
                text, items = data[offsets[i] : offsets[i + 1]], batch.column("items")[i].values
                h, at, hot = (np.asarray(items.field(c)) if c != "hot" else np.asarray(items.field(c).cast(pa.int8())) for c in ("h", "at", "hot"))
                start, windows = at >> 8, at & 255
                cool = np.flatnonzero(hot == 0)
                if len(cool):
                    pieces = [text[s : s + w + length - 1].tobytes() for s, w in zip(start[cool].tolist(), windows[cool].tolist(), strict=True)]
                    yield from_columns(h[cool], np.zeros(len(cool), np.int64), docs[i], keys[i], at[cool], pieces)
                warm = np.flatnonzero(hot)
                if len(warm):
                    each = np.repeat(start[warm], windows[warm]) + np.arange(windows[warm].sum()) - np.repeat(np.cumsum(windows[warm]) - windows[warm], windows[warm])
                    one = np.concatenate([hash_spans(text[s : s + w + length - 1], np.arange(w), np.arange(w) + length) for s, w in zip(start[warm].tolist(), windows[warm].tolist(), strict=True)])
                    two = np.concatenate([hash_spans(text[s : s + w + length - 1][::-1], np.arange(w)[::-1], np.arange(w)[::-1] + length) for s, w in zip(start[warm].tolist(), windows[warm].tolist(), strict=True)])
                    yield from_columns(one.view(np.int64), mix(two).view(np.int64), docs[i], keys[i], each * 256 + 1, None)

    def from_columns(h, fp, doc, key, at, pieces):
        n = len(h)
        pieces = pa.array(pieces, pa.binary()) if pieces else pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(fp), pa.array(np.full(n, doc)), pa.array(np.full(n, key)), pa.array(at), pieces], names=["h", "fp", "doc", "key", "at", "bytes"])

    # A sort-merge join at every size: it brings rows that repeat a document together.
    met = texts.join(wanted.hint("merge"), ["doc", "key"]).select("doc", "key", "items", "text")
    met = cut_lineage(met.mapInArrow(fetch, "h long, fp long, doc long, key long, at long, bytes binary"))

    def compare(batches):
        for table in _buckets(batches, 2048):
            yield _repeats(table, length)

    cool = met.where("bytes IS NOT NULL").select("h", "doc", "key", "at", "bytes")
    inside = cool.repartition("h").sortWithinPartitions("h").mapInArrow(compare, "doc long, key long, low long, high long")
    warm = met.where("bytes IS NULL").drop("bytes")
    return _later(classes, first, length).unionAll(inside).unionAll(_later(warm, cut_lineage(_first(warm)), length))


def cut_repeats(docs: DataFrame, length: int = 100, k: int = 64, most: int = 512) -> DataFrame:
    """`docs` (doc_id, text) as doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans.

    A NULL text is the empty text; texts of fewer than `length` bytes stay whole; matches never cross texts. NULL ids come
    first. Rows equal in id and text are one document and all get its result; of rows with one id and several texts, the
    order follows the hash of the text. Cuts may fall inside a character, so what is kept is binary. Other columns are
    ignored, an empty table gives no rows. Classes of segments and windows are told apart by 128 bits of hashes.
    """
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    spans = repeated_spans(keyed.select("doc", "key", "text"), length, k, most)
    spans = cut_lineage(spans.groupBy("doc", "key").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            kept, size, removed, runs = [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                raw = text.encode() if text else b""
                spans = batch.column("spans")[i]
                low, high = merged(spans.values) if spans.is_valid else (np.zeros(0, np.int64),) * 2
                edges = [0, *np.stack((low, high), 1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(raw))
                removed.append(int((high - low).sum()))
                runs.append(len(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in (size, removed, runs)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = keyed.join(spans, ["doc", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def merged(spans: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans (low, high) cover."""
    low, high = np.asarray(spans.field("low")), np.asarray(spans.field("high"))
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    head = np.ones(len(low), dtype=bool)
    head[1:] = low[1:] > high[:-1]
    return low[head], high[np.append(np.flatnonzero(head)[1:], len(low)) - 1]
