"""WARC archives: writer with payload deduplication, and a salvaging reader.

Writing: records are gzip members, laid end to end by Spark's own text writer (an
empty gzip member stands for the line end), so archives reach any store
that Spark writes to, under its commit protocol. A written row is a whole archive, cut by
bytes, so that a reader's task never meets a file much larger than one record. Of equal
payloads the smallest id is a response and the others revisit it.

Reading: each member or plain record is checked (gzip checksum, header syntax,
length, block digest). After a failed check of a record inside a sound member the
reader goes on at the next version line of what the member holds. Of a damaged or cut
member it keeps the sound records of what unpacks, but for one that the damage follows
at once, and looks for the next member or the next plain version line, as after a failed
plain record. The bytes between are logged as
quarantined; inside a member, as the member's bytes with the unpacked places named.

Defined results: a null payload is empty; a null id is written as an empty id,
always as a response, and read as null; rows with the same smallest id and equal
payloads are all responses; an empty table writes an archive without records; extra
columns are ignored; control characters in a target address are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekit import arrow_batches
from .storage import is_small, saved

#: A file ends with the record that takes it past this many bytes: it holds no more than these and one record.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x02\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_RECORD = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = re.compile(rb"\x1f\x8b\x08")
_BLANK = re.compile(rb"\r\n\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: an HTTP response, or a revisit with its headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages(__id, __url, __payload) and refers_to."""
    spark = pages.sparkSession
    key = F.sha1("__payload")
    can = F.octet_length("__payload") >= min_bytes
    groups = pages.where(can & F.col("__id").isNotNull()).groupBy(key.alias("__digest")).agg(F.min("__id").alias("__first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = saved(spark, groups, "payload-groups")
    keyed = pages.withColumn("__digest", F.when(can, key))
    if is_small(groups):
        joined = keyed.join(F.broadcast(groups), "__digest", "left")
        return joined.withColumn("refers_to", F.when(F.col("__id") != F.col("__first"), F.col("__first"))).drop("__first", "__digest")
    # Many groups: find revisits among narrow rows, where AQE can split a hot digest, and join payloads by their own ids.
    narrow = keyed.select("__id", "__digest").join(groups, "__digest").where("__id <> __first").select("__id", "__digest", F.col("__first").alias("refers_to")).distinct()
    return keyed.join(saved(spark, narrow, "revisits"), ["__id", "__digest"], "left").drop("__digest")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes one record per row under path."""
    arrow_batches(pages.sparkSession)
    body = F.col(f"`{payload}`").cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("__id"), F.col(f"`{url}`").cast("string").alias("__url"), F.coalesce(body, F.lit(b"")).alias("__payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                held.append(member(record(*(c[i].as_py() for c in b.columns))))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    ready = _with_revisits(rows, min_bytes).select("__id", "__url", "__payload", "refers_to")
    members = ready.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = members.write.mode("overwrite").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", 1).text(path)


class _Ahead:
    """The next place of each mark. Places are asked for in rising order, so however much is damaged, no byte is searched twice for the same mark."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def next(self, mark: re.Pattern, start: int) -> int:
        """Where the mark is next, or the end of the data."""
        if self.found.get(mark, -1) < start:
            m = mark.search(self.data, start)
            self.found[mark] = m.start() if m else len(self.data)
        return self.found[mark]


def _headers(data: bytes, at: int, stop: int) -> dict[str, str]:
    """Line by line, up to the first that is none: a version line among them ends it."""
    out = {}
    while at < stop:
        end = data.find(b"\r\n", at, stop)
        end = stop if end < 0 else end
        k, sep, v = data[at:end].partition(b":")
        if not sep:
            raise ValueError("a header line without a colon")
        out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        at = end + 2
    return out


def parse_record(data: bytes, at: int, ahead: _Ahead | None = None) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place; raises ValueError where a check fails. The block is copied only where it ends as its length says."""
    m = _RECORD.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = (ahead or _Ahead(data)).next(_BLANK, m.end())
    if stop >= len(data):
        raise ValueError("headers are cut off")
    head = _headers(data, m.end(), stop)
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("no length")
    end = stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block does not end where its length says")
    block = data[stop + 4 : end]
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != digest32(block):
        raise ValueError("the block's digest differs")
    return head, block, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None, bool]:
    """What the member at a place holds, its end, why it stops early if it does, and whether it merely ends too soon."""
    z, out, step, begin = zlib.decompressobj(31), [], 1 << 13, at
    while not z.eof and at < len(data):
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error as e:
            return b"".join([*out, _before_error(data, begin, at, step)]), at, str(e), False
        at += step
    if not z.eof:
        return b"".join(out), len(data), "the member is cut off", True
    return b"".join(out), min(at, len(data)) - len(z.unused_data), None, False


def _before_error(data: bytes, begin: int, at: int, step: int) -> bytes:
    """What the part at a place unpacks to before its error: the member is read again, this part byte by byte."""
    z, out = zlib.decompressobj(31), []
    for i in range(begin, at, step):
        z.decompress(data[i : i + step])
    try:
        for i in range(at, min(at + step, len(data))):
            out.append(z.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _unpacked(inner: bytes, vouched: bool) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """Like `salvage`, of what a member holds. Where the member's checksum does not vouch for its bytes, a block digest must."""
    at, ahead = 0, _Ahead(inner)
    while at < len(inner):
        try:
            head, block, end = parse_record(inner, at, ahead)
            if not vouched and not head.get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError("a damaged member's record without a digest")
            yield at, end, head, block, None
        except ValueError as e:
            end = ahead.next(_RECORD, at + 1)
            yield at, end, None, None, str(e)
        at = end


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(start, end, headers, block, None) of every good record, and (start, end, None, None, reason) of every quarantined gap; bytes of the file."""
    at, bad_from, reason = 0, None, ""
    ahead = _Ahead(data)
    saved_there: list = []  # records of the damaged member; an unpacked copy of them may lie in its stored blocks
    while at < len(data):
        good: list = []
        try:
            if _MEMBER.match(data, at):
                inner, end, why, short = _inflate(data, at)
                rows = list(_unpacked(inner, why is None or short))
                if why:
                    saved_there = [(h, b) for _, j, h, b, _ in rows if h and j < len(inner)]
                    yield from ((at, end, h, b, None) for h, b in saved_there)
                    raise ValueError(why)
                good = [(at, end, h, b, r and f"{r} (unpacked bytes {i} to {j})") for i, j, h, b, r in rows]
            else:
                head, block, end = parse_record(data, at, ahead)
                if (head, block) not in saved_there:
                    good = [(at, end, head, block, None)]
        except ValueError as e:
            if bad_from is None:
                bad_from, reason = at, str(e)
            at = min(ahead.next(_MEMBER, at + 1), ahead.next(_RECORD, at + 1))
            continue
        if bad_from is not None and (good or _MEMBER.match(data, at)):
            yield bad_from, at, None, None, reason
            bad_from, saved_there = None, []
        yield from good
        at = end
    if bad_from is not None:
        yield bad_from, len(data), None, None, reason


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", uri or "")
    return int(m[1]) if m else None


READ_SCHEMA = "file string, start bigint, end bigint, record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, problem string"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under path (problem is null), and quarantined gaps (record_type is null, problem says why)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
        for b in batches:
            for i in range(b.num_rows):
                name, rows, size = b.column(0)[i].as_py(), [], 0
                for start, end, head, block, why in salvage(b.column(1)[i].as_py()):
                    if head is None:
                        rows.append((name, start, end, None, None, None, None, None, None, None, why))
                    else:
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = head.get("warc-type") == "revisit"
                        n = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})", http)
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest32(payload)
                        problem = None if revisit or "sha1:" + digest == head.get("warc-payload-digest", "sha1:" + digest) else "the payload's digest differs"
                        rows.append((name, start, end, head.get("warc-type"), _page(head.get("warc-record-id")), head.get("warc-target-uri"), _page(head.get("warc-refers-to")), int(n[1]) if revisit and n else len(payload), digest, None if revisit or not with_payload else payload, problem))
                        size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return files.mapInArrow(run, READ_SCHEMA)
