"""Fill-in-middle over seekable compressed text: independent zstandard frames with cumulative unit counts.

1. `store_frames` cuts each text into frames of bounded size, compressed on their own, and notes how many code points lie
   up to the end of each.
2. `fill_in_middle` draws two cuts from the hash of the id, decompresses only the frames that hold a cut, and puts the
   output together from whole frames as they are, cut pieces and markers; the output is again a list of frames.
3. `with_digests` streams the frames of an output in order through SHA-256, then rebuilds the text by seeking to the
   pieces between the markers. One frame is open at a time.

A NULL text is the empty text; a NULL id is hashed as no digits. Rows may repeat ids or texts and are treated each on
their own, empty tables give empty results, texts of any length are held compressed plus one frame, and other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.session import cut_lineage

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text in a frame at most, and of rows in a batch that is handed on.
FRAME, BATCH = 1 << 16, 1 << 24

FRAMES = "frames array<binary>, ends array<long>"
_ARROW = [pa.list_(pa.binary()), pa.list_(pa.int64())]


def compressed(raw: bytes, size: int = FRAME) -> Iterator[tuple[bytes, int]]:
    """(frame, code points) of consecutive stretches of at most `size` bytes, cut between code points."""
    pack, at = zstandard.ZstdCompressor(level=3), 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        piece = raw[at:end]
        yield pack.compress(piece), len(piece.decode())
        at = end


class Frames:
    """Reads frames in order or from a place; offsets come from the frame headers."""

    def __init__(self, frames: list[bytes]):
        self.frames, self.offsets = frames, [0]
        for f in frames:
            self.offsets.append(self.offsets[-1] + zstandard.frame_content_size(f))
        self.open_, self.raw = -1, b""

    def frame(self, i: int) -> bytes:
        if self.open_ != i:
            self.open_, self.raw = i, zstandard.ZstdDecompressor().decompress(self.frames[i])
        return self.raw

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        for i in range(max(0, bisect_left(self.offsets, start + 1) - 1), len(self.frames)):
            at = self.offsets[i]
            if at >= end:
                return
            raw = self.frame(i)
            yield raw if start <= at and at + len(raw) <= end else raw[max(0, start - at) : end - at]

    def find(self, mark: bytes, start: int) -> int:
        """Place of the first `mark` at or after `start`, also across frames; -1 if there is none."""
        tail, at = b"", start
        for raw in self.read(start, self.offsets[-1]):
            window = tail + raw
            found = window.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(raw)
            tail = window[len(window) - len(mark) + 1 :]
        return -1


def _piece(frames: list[bytes], ends: list[int], start: int, end: int, cut) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes, code points, compressed?) of the code points start..end: whole frames as they are, parts as text."""
    i = bisect_left(ends, start + 1)
    while i < len(frames) and start < end:
        low = ends[i - 1] if i else 0
        if start == low and ends[i] <= end:
            yield frames[i], ends[i] - low, True
        else:
            part = cut(i)[start - low : end - low]
            yield part.encode(), len(part), False
        start, i = ends[i], i + 1


def spliced(pieces: Iterator[tuple[bytes, int, bool]]) -> tuple[list[bytes], list[int]]:
    """Frames and cumulative code points of the pieces; neighbouring parts share frames."""
    frames, ends, held = [], [], []

    def flush():
        for frame, units in compressed(b"".join(held)):
            frames.append(frame)
            ends.append((ends[-1] if ends else 0) + units)
        held.clear()

    for data, units, whole in pieces:
        if whole:
            flush()
            frames.append(data)
            ends.append((ends[-1] if ends else 0) + units)
        else:
            held.append(data)
    flush()
    return frames, ends


def middle_form(frames: list[bytes], ends: list[int], a: int, b: int, form: str) -> tuple[list[bytes], list[int]]:
    """Frames of the text with its middle, the code points a..b, moved to the end."""
    n, seen = ends[-1], {}

    def cut(i: int) -> str:
        if i not in seen:
            seen[i] = zstandard.ZstdDecompressor().decompress(frames[i]).decode()
        return seen[i]

    def pieces():
        prefix, suffix = ((PREFIX, 0, a), (SUFFIX, b, n))
        for mark, start, end in ((prefix, suffix) if form == "psm" else (suffix, prefix)) + ((MIDDLE, a, b),):
            yield mark, len(mark), False
            yield from _piece(frames, ends, start, end, cut)

    return spliced(pieces())


def restored(source: Frames, form: str) -> Iterator[bytes]:
    """The text in stretches, from an output and its form."""
    whole = source.offsets[-1]
    if form == "plain":
        yield from source.read(0, whole)
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = source.find(first, 0)
    to = source.find(second, at + len(first))
    last = source.find(MIDDLE, to + len(second))
    parts = {first: (at + len(first), to), second: (to + len(second), last), MIDDLE: (last + len(MIDDLE), whole)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from source.read(*parts[mark])


def _grouped(rows: Iterator[tuple], weigh, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def store_frames(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """(doc_id, n, marked, frames, ends) as a written table; n counts code points, marked texts hold a marker."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches):
        for batch in batches:
            types = [batch.schema.types[0], pa.int64(), pa.bool_(), *_ARROW]

            def rows(batch=batch):
                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py()
                    raw = text.encode() if text else b""
                    pairs = list(compressed(raw, size))
                    ends, total = [], 0
                    for _, units in pairs:
                        total += units
                        ends.append(total)
                    marked = any(m in raw for m in (PREFIX, SUFFIX, MIDDLE))
                    yield batch.column(0)[i].as_py(), total, marked, [f for f, _ in pairs], ends

            yield from _grouped(rows(), lambda r: 100 + sum(map(len, r[3])), ["doc_id", "n", "marked", "frames", "ends"], types)

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n long, marked boolean, {FRAMES}"))


def fill_in_middle(store: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames, ends): the output of each text of a store.

    Of 100 texts about `rate` are rearranged, of these about `spm` with the suffix first. Empty texts and those that
    hold a marker stay plain.
    """
    kind = store.schema["doc_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = F.col("marked") | (F.col("n") == 0) | (number[2] % 100 >= rate)
    form = F.when(plain, "plain").when(number[3] % 100 < spm, "spm").otherwise("psm")
    cuts = [number[k] % (F.col("n") + 1) for k in (0, 1)]
    drawn = store.select("doc_id", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), "frames", "ends")

    def arrange(batches):
        for batch in batches:
            types = [batch.schema.types[0], pa.int64(), pa.string(), pa.int64(), pa.int64(), *_ARROW]

            def rows(batch=batch):
                for i in range(batch.num_rows):
                    doc_id, n, form, a, b, frames, ends = (c[i].as_py() for c in batch.columns)
                    if form == "plain":
                        yield doc_id, n, form, None, None, frames, ends
                    else:
                        yield doc_id, n, form, a, b - a, *middle_form(frames, ends, a, b, form)

            yield from _grouped(rows(), lambda r: 100 + sum(map(len, r[5])), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames", "ends"], types)

    return drawn.mapInArrow(arrange, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {FRAMES}")


def with_digests(outputs: DataFrame) -> DataFrame:
    """`outputs` with output_sha256 of the output and restored_sha256 of the text rebuilt from it, in place of the frames."""
    kept = [c for c in outputs.columns if c not in ("frames", "ends")]

    def digest(batches):
        for batch in batches:
            out, back = [], []
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("frames"), strict=True):
                source = Frames([f.as_py() for f in frames.values] if len(frames) else [])
                made, rebuilt = hashlib.sha256(), hashlib.sha256()
                for raw in source.read(0, source.offsets[-1]):
                    made.update(raw)
                for raw in restored(source, form):
                    rebuilt.update(raw)
                out.append(made.hexdigest())
                back.append(rebuilt.hexdigest())
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array(back, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    schema = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in kept)
    return outputs.select(*[F.col(f"`{c}`") for c in kept], "frames").mapInArrow(digest, f"{schema}, output_sha256 string, restored_sha256 string")
