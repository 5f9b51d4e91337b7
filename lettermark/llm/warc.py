"""WARC archives: one gzip member a record, written by tasks, read back by byte range."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermark.session import cut_lineage, shared_folder

MAGIC, MARK, VERSION, PAGE = b"\x1f\x8b\x08", b"WARC/1.", b"WARC/1.1", "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once inside a range and, at first, behind it; bytes that a decoder takes at once.
CHUNK, BEHIND, PIECE = 1 << 20, 1 << 16, 1 << 14


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that only names size and digest of the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    names = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        **({"WARC-Refers-To": f"<{PAGE}{refers_to}>", "WARC-Profile": PROFILE} if revisit else {}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in names.items()) + b"\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


class Source:
    """The bytes of a file for the range that ends at `end`: as long as offsets only grow, each byte is read once.

    Inside the range CHUNK bytes are read at once; behind it, where only the last record goes on, BEHIND at first and
    then twice as many each time.
    """

    def __init__(self, file, end: int):
        self.file, self.end, self.behind = file, end, BEHIND
        self.at, self.held = 0, b""

    def fill(self, at: int) -> bytes:
        if at < self.end:
            most = min(CHUNK, self.end - at)
        else:
            most, self.behind = self.behind, min(CHUNK, 2 * self.behind)
        self.file.seek(at)
        self.at, self.held = at, self.file.read(most)
        return self.held

    def piece(self, at: int) -> bytes:
        """Up to PIECE bytes from `at` on, none behind the end of the file."""
        if not self.at <= at < self.at + len(self.held):
            self.fill(at)
        return self.held[at - self.at : at - self.at + PIECE]


class Member:
    """Decodes the gzip member at `at`; `end` is where it ends, or None if it is none."""

    def __init__(self, source: Source, at: int):
        self.at, self.end, self.data = at, None, b""
        decoder, parts = zlib.decompressobj(31), []
        try:
            while not decoder.eof and (raw := source.piece(at)):
                parts.append(decoder.decompress(raw))
                at += len(raw)
        except zlib.error:
            return
        self.data = b"".join(parts)
        if decoder.eof:
            self.end = at - len(decoder.unused_data)


def _starts_record(source: Source, at: int) -> bool:
    decoder, head = zlib.decompressobj(31), b""
    try:
        while len(head) < len(MARK) and not decoder.eof and (raw := source.piece(at)):
            head += decoder.decompress(raw, len(MARK) - len(head))
            at += len(raw)
    except zlib.error:
        return False
    return head == MARK


def first_record(source: Source, start: int, end: int, size: int) -> Member | None:
    """The first record that starts in [start, end).

    A magic number may be part of compressed data: a candidate must decode whole to a WARC record and be followed by
    the next record or the end of the file.
    """
    at = start
    while at < end:
        raw = source.fill(at)
        here = raw.find(MAGIC)
        while here >= 0 and at + here < end:
            found = Member(source, at + here) if _starts_record(source, at + here) else None
            if found is not None and found.end is not None and (found.end == size or _starts_record(source, found.end)):
                return found
            here = raw.find(MAGIC, here + 1)
        at += max(1, len(raw) - len(MAGIC) + 1)
    return None


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, WARC headers, block) of every record that starts in [start, end)."""
    source = Source(file, min(size, end + len(MAGIC) - 1))
    member = first_record(source, start, end, size)
    while member is not None:
        if member.end is None:
            raise ValueError(f"broken record at byte {member.at}")
        head, _, rest = member.data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield member.at, names, rest[: int(names["content-length"])]
        member = Member(source, member.end) if member.end < min(size, end) else None


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html, refers_to); returns (path, size) of the archives.

    Every task writes an archive of its own below `folder`; only those listed count, so a task may run again.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page_id, url, html, refers_to = row
                    n += out.write(record(page_id, url, (html or "").encode(), refers_to))
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [n]})
        else:
            store.delete_file(path)

    return cut_lineage(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, size long"))


def read_archives(archives: DataFrame, folder: str, range_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives (path, size): page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Each archive is read in byte ranges; a range owns the records that start in it.
    """

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with store.open_input_file(path) as file:
                    for _, names, block in records(file, start, end, size):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = names["warc-type"]
                        if kind == "response":
                            length, digest = len(payload), base32_sha1(payload)
                        else:
                            fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                            length, digest = int(fields["Content-Length"]), names["warc-payload-digest"].removeprefix("sha1:")
                        page, refers = (names.get(k, "").strip("<>").removeprefix(PAGE) for k in ("warc-record-id", "warc-refers-to"))
                        rows.append((int(page) if page else None, length, digest, kind, int(refers) if refers else None, names["warc-target-uri"]))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    parallel = 4 * archives.sparkSession.sparkContext.defaultParallelism
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, "size")).repartition(parallel, "path", "start")
    return ranges.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with refers_to: the largest page_id of equal payloads of at least `least_bytes`.

    That page itself, smaller payloads and NULL ids have NULL. Rows that repeat both id and payload are all responses.
    Only ids and fingerprints are grouped; the payloads meet the few revisits in one join.
    """
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("print"))
    ids = pages.where(F.octet_length(payload) >= least_bytes).select("page_id", F.sha2(payload, 256).alias("print"))
    groups = ids.groupBy("print").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("least")).where("least < latest")
    revisits = ids.join(groups, "print").where("page_id < latest").select("page_id", "print", F.col("latest").alias("refers_to")).distinct()
    return marked.join(cut_lineage(revisits), ["page_id", "print"], "left").select("page_id", "url", "html", "refers_to")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the session's shared folder and read them back; see `read_archives`.

    A NULL html is an empty payload and a NULL url an empty target; other columns are ignored, an empty table gives no
    rows, and a NULL page_id comes back as NULL.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder), folder)
