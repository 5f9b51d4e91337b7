"""Token ids of documents in bit-packed files: encode, write in the order of doc_id, read back.

A file holds blocks of `BLOCK` ids, each id in the fewest bits that hold the vocabulary (least significant bit first),
then the documents (id, NULL mark, end position) and the byte offset of every block, and last a fixed trailer. Any block
can be read on its own and unpacked by one numpy call.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermark.llm.arrow import NOT_SPACE, hash_spans, slices, text_bytes
from lettermark.session import cut_lineage, shared_folder

MAGIC, BLOCK = b"LMTOKEN1", 4096
#: magic, bits of an id, ids in a block, ids, documents, offset of the documents, offset of the block table
TRAILER = "<8sIIQQQQ"
ASCII_LETTER, ASCII_MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
#: Punctuation but the apostrophe, which may start a contraction.
ASCII_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


class Encoder:
    """Whole texts to ids through a `tokenizers` file, without special tokens.

    Texts are cut where the byte-level pattern always cuts: before a space that follows no white space, between a
    letter and punctuation, and after a single newline. Pieces are told apart by 64-bit hashes; only pieces not met
    before are encoded, and a bounded table keeps their ids. Texts that hold an added token of the file, such as an
    end mark, are encoded whole: such a token is taken before the pattern, and a cut could fall inside it.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_file(path), most
        self.word = Tokenizer(self.whole.model)  # the same model, held once
        if self.whole.normalizer is not None:
            self.word.normalizer = self.whole.normalizer
        self.word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.bits = max(1, (self.whole.get_vocab_size() - 1).bit_length())
        self._clear()

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The encoder that this Python worker keeps between its tasks."""
        kept = sys.__dict__.setdefault("_lettermark_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _clear(self) -> None:
        self.hashes, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, column) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column; NULL is the empty text."""
        offsets, data = text_bytes(column)
        for a, b in slices(offsets, 1 << 18):
            raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = np.flatnonzero(_cuts(raw, at))
            ends = np.append(starts[1:], len(raw))
            marked = self._marked(raw, at)
            if len(marked):
                plain = ~np.isin(np.searchsorted(at, starts, "right") - 1, marked)
                starts, ends = starts[plain], ends[plain]
            kinds, first, kind = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
            where = self._known(kinds, raw, starts[first], ends[first])
            size, place = self.size[where][kind], self.place[where][kind]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])]
            cut = total[np.searchsorted(starts, at)]
            alone = set(marked.tolist())
            for row, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if row in alone:
                    text = raw[at[row] : at[row + 1]].tobytes().decode()
                    yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[i:j]

    def _marked(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows that hold an added token."""
        text, rows = raw.tobytes(), []
        for token in self.added:
            place = text.find(token)
            while place >= 0:
                row = int(np.searchsorted(at, place, "right")) - 1
                inside = place + len(token) <= at[row + 1]
                if inside:
                    rows.append(row)
                place = text.find(token, int(at[row + 1]) if inside else place + 1)
        return np.unique(np.array(rows, np.int64))

    def _known(self, kinds: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the table that hold the pieces, after encoding the new ones."""
        if len(self.hashes) + len(kinds) > self.most:
            self._clear()
        where = np.searchsorted(self.hashes, kinds)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[where] != kinds) if len(self.hashes) else np.arange(len(kinds))
        new = np.union1d(new, np.flatnonzero(where == len(self.hashes)))
        if len(new):
            text = raw.tobytes()
            pieces = [text[i:j].decode() for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            word = np.array([p.removeprefix(" ").isalpha() for p in pieces], dtype=bool)
            ids, size = [], np.zeros(len(new), np.int64)
            words = np.flatnonzero(word)
            for k in range(0, len(words), 1000):
                some = words[k : k + 1000]
                got = self.word.encode([pieces[i] for i in some], is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(got.ids, np.uint32))
                size[some] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
            others = np.flatnonzero(~word)
            if len(others):
                got = self.whole.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)
                ids += [np.array(e.ids, np.uint32) for e in got]
                size[others] = [len(e.ids) for e in got]
            order = np.concatenate((words, others))
            place = np.zeros(len(new), np.int64)
            place[order] = self.used + np.concatenate(([0], np.cumsum(size[order])[:-1]))
            fresh = np.concatenate(ids)
            if self.used + len(fresh) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(self.pool) + len(fresh), np.uint32)))
            self.pool[self.used : self.used + len(fresh)] = fresh
            self.used += len(fresh)
            at = np.searchsorted(self.hashes, kinds[new])
            self.hashes, self.place, self.size = (np.insert(old, at, more) for old, more in ((self.hashes, kinds[new]), (self.place, place), (self.size, size)))
            where = np.searchsorted(self.hashes, kinds)
        return where


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a piece may start: at the texts' starts, and where the pattern cuts whatever stands around.

    Characters of three bytes below U+4000, and those from U+0080 to U+00BF, count as possible white space.
    """
    n = len(raw)
    cut = np.zeros(n, dtype=bool)
    if n > 2:
        space = ~NOT_SPACE[raw] | ((raw >= 28) & (raw < 32))
        maybe = space.copy()
        lead2, lead3 = raw == 0xC2, (raw >= 0xE1) & (raw <= 0xE3)
        maybe |= lead2 | lead3
        maybe[1:] |= lead2[:-1] | lead3[:-1]
        maybe[2:] |= lead3[:-2]
        letter = ASCII_LETTER[raw]
        cut[1:] = (raw[1:] == 32) & ~maybe[:-1]
        cut[1:] |= letter[:-1] & ASCII_MARK[raw[1:]]
        cut[2:] |= (raw[1:-1] == 10) & ~maybe[:-2] & ~maybe[2:]
    cut[at[:-1][at[:-1] < n]] = True
    return cut


def write_file(out, bits: int, docs: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write documents to a binary stream; returns their number and that of their ids."""
    at, total, names, ends, offsets, held, waiting = 0, 0, [], [], [], [], 0

    def flush(rest: bool) -> int:
        nonlocal held, waiting, at
        ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
        n = len(ids) if rest else len(ids) // BLOCK * BLOCK
        for k in range(0, n, BLOCK):
            data = pack(ids[k : k + BLOCK], bits)
            offsets.append(at)
            out.write(data)
            at += len(data)
        held, waiting = [ids[n:]], len(ids) - n

    for name, ids in docs:
        held.append(ids)
        total += len(ids)
        waiting += len(ids)
        names.append(name)
        ends.append(total)
        if waiting >= 64 * BLOCK:
            flush(False)
    flush(True)
    docs_at = at
    null = np.array([n is None for n in names], np.uint8)
    for part in (np.array([n or 0 for n in names], "<i8"), null, np.array(ends, "<u8")):
        out.write(part.tobytes())
        at += part.nbytes
    out.write(np.array(offsets, "<u8").tobytes())
    out.write(struct.pack(TRAILER, MAGIC, bits, BLOCK, total, len(names), docs_at, at))
    return len(names), total


class TokenFile:
    """Random access to one file of `write_file`."""

    def __init__(self, file, size: int):
        self.file = file
        magic, self.bits, self.block, self.n_ids, self.n_docs, docs_at, table_at = struct.unpack(TRAILER, self._read(size - struct.calcsize(TRAILER), struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a token file")
        raw = self._read(docs_at, 17 * self.n_docs)
        names, null = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs)
        self.doc_ids = [None if z else int(n) for n, z in zip(names, null, strict=True)]
        self.ends = np.concatenate(([0], np.frombuffer(raw, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)))
        self.offsets = np.append(np.frombuffer(self._read(table_at, size - struct.calcsize(TRAILER) - table_at), "<u8").astype(np.int64), docs_at)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, reading only their blocks."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        data = self._read(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a]))
        if self.bits % 8 == 0 or b == a + 1:
            ids = unpack(data, min(b * self.block, self.n_ids) - a * self.block, self.bits)
        else:
            counts = [min((k + 1) * self.block, self.n_ids) - k * self.block for k in range(a, b)]
            cut = self.offsets[a : b + 1] - self.offsets[a]
            ids = np.concatenate([unpack(data[cut[k] : cut[k + 1]], n, self.bits) for k, n in enumerate(counts)])
        return ids[start - a * self.block : end - a * self.block]

    def documents(self, step: int = 256) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of each document."""
        for k in range(0, self.n_docs, step):
            ends = self.ends[k : k + step + 1]
            ids = self.ids(int(ends[0]), int(ends[-1]))
            for i in range(len(ends) - 1):
                yield self.doc_ids[k + i], int(ends[i]), ids[ends[i] - ends[0] : ends[i + 1] - ends[0]]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write `docs` (doc_id, text) below `folder`, a file for each range of doc_id; returns the files.

    (file, path, n_docs, n_ids, start): `start` is the number of ids in all files before. Only the files listed count;
    a task that is run again writes another file. NULL texts are empty, NULL ids come first, rows with equal ids follow
    each other in any order, and every document ends with `end_id`. No file comes from a range without rows.
    """

    def write(batches):
        model = Encoder.of_worker(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        path, part = f"{root}/{uuid.uuid4().hex}.ids", TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)

        def rows():
            for batch in batches:
                for name, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1)), strict=True):
                    yield name, np.concatenate((ids, end))

        store.create_dir(root, recursive=True)
        with store.open_output_stream(path) as out:
            n_docs, n_ids = write_file(out, model.bits, rows())
        if n_docs:
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            store.delete_file(path)

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = cut_lineage(ranged.mapInArrow(write, "file long, path string, n_docs long, n_ids long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of `write_tokens`."""

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    rows = [(name, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for name, at, ids in TokenFile(file, file.size()).documents()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parallel = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "start").repartition(parallel, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write `docs` as token files in the session's shared folder and read them back; see `write_tokens`."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(cut_lineage(write_tokens(docs, tokenizer, folder, end_id)), folder)
