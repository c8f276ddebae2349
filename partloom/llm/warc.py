"""WARC archives: a writer of gzip members, one for each record, and a splittable reader.

The reader deals out byte ranges of the files. A task looks for the magic bytes of a gzip member in its range and takes a
place for a record only if the bytes there inflate to the version line and headers of a record and the member's check sum
holds. It owns the records that begin inside its range and reads beyond the range's end to finish the last one. Where a
member is broken, the search goes on behind its first byte, so damage costs one record.

The writer finds, for each payload that several pages share, the page with the largest id; that one is written as a
response, the others as revisits that refer to it and carry its HTTP headers, digest and no payload. Payloads are compared
by their SHA-1 and length; only ids, digests and lengths are shuffled for this.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.shared import filesystem, new_path, stored

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 8 << 20
_STEP = 1 << 16


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id of ours; null for others."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed; the same bytes for the same page whenever a task is run again."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes one archive for each task into the shared folder; returns path, n_records and n_bytes of each.

    Null html is an empty payload. Payloads of fewer than least_bytes are all responses. Of repeated rows with the largest
    id of a payload all are responses. Pages with a null id come after all others in that choice. Extra columns are
    ignored; an empty table gives no archive.
    """
    base = new_path(pages.sparkSession, "warc")
    files, where = filesystem(base)
    files.create_dir(where)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    keys = stored(rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("n")).where(F.col("n") >= least_bytes), "payload-keys")
    shared = keys.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1 and refers_to is not null")
    again = keys.join(shared, ["sha", "n"]).where("page_id is null or page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    marked = rows.withColumn("sha", F.sha1("payload")).join(again.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n, size, path = TaskContext.get(), None, 0, 0, ""
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    files, where = filesystem(path)
                    out = files.open_output_stream(where, compression=None)
                data = member(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), refers_to.is_valid)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return stored(marked.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


class _Range:
    """Bytes of a file from one place on, fetched in steps and forgotten behind the place that is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""

    def bytes_from(self, at: int, n: int) -> bytes:
        if at < self.at or at > self.at + len(self.data):
            self.at, self.data = at, b""
        while len(self.data) < at - self.at + n:
            self.file.seek(self.at + len(self.data))
            more = self.file.read(max(_STEP, n))
            if not more:
                break
            self.data += more
        if at - self.at > 16 * _STEP:
            self.at, self.data = at, self.data[at - self.at :]
        return self.data[at - self.at : at - self.at + n]


def _inflated(data: _Range, at: int) -> tuple[bytes, int] | None:
    """A member's content and the place behind it, or None if no whole record begins there."""
    unpack, parts, begun, place = zlib.decompressobj(31), [], False, at
    try:
        while not unpack.eof:
            raw = data.bytes_from(place, _STEP)
            if not raw:
                return None
            place += len(raw)
            parts.append(unpack.decompress(raw))
            if not begun and (head := b"".join(parts))[:5] != b"WARC/"[: len(head)]:
                return None
            begun = begun or len(parts[0]) >= 5
    except zlib.error:
        return None
    content = b"".join(parts)
    return (content, place - len(unpack.unused_data)) if content.startswith(b"WARC/1.") else None


def parsed(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if the block isn't as long as it says."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    if not gap:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    n = headers.get("content-length", "")
    return (headers, rest[: int(n)]) if n.isascii() and n.isdigit() and len(rest) >= int(n) else None


def records(path: str, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of the records that begin in [begin, end)."""
    files, where = filesystem(path)
    with files.open_input_file(where) as file:
        data, at = _Range(file, begin), begin
        while at < end:
            raw = data.bytes_from(at, min(_STEP, end - at) + len(MAGIC) - 1)
            found = raw.find(MAGIC)
            if found < 0:
                at += max(1, len(raw) - len(MAGIC) + 1)
                if not raw:
                    return
                continue
            at += found
            if at >= end:
                return
            if (got := _inflated(data, at)) and (record := parsed(got[0])):
                yield at, *record
                at = got[1]
            else:
                at += 1


def read_warc(archives: DataFrame, *, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of archives (path, n_bytes): record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest,
    digest_ok and payload (null unless payloads). Length and digest of a response come from the payload itself, those of a
    revisit from its headers."""
    n = F.greatest(F.ceil(F.col("n_bytes") / F.lit(split_bytes)), F.lit(1)).cast("int")
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("path", (F.col("i") * F.lit(split_bytes).cast("long")).alias("begin"), ((F.col("i") + 1) * F.lit(split_bytes).cast("long")).alias("end"))
    kinds = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, size = [], 0
                for _, headers, block in records(row["path"], row["begin"], row["end"]):
                    http, gap, payload = block.partition(b"\r\n\r\n")
                    said, revisit = headers.get("warc-payload-digest", "").removeprefix("sha1:"), headers.get("warc-type") == "revisit"
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    digest = said if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    out.append(dict(zip(kinds.names, (headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), (int(length[1]) if length else None) if revisit else len(payload), digest, digest == said, payload if payloads and not revisit else None), strict=True)))
                    size += len(payload) if payloads else 0
                    if len(out) >= 1000 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
    # a number of our own, as rows of a few bytes that stand for megabytes would be merged into one task
    return ranges.repartition(max(1, ranges.count()), "path", "begin").mapInArrow(read, schema)


def page_id_of(record: str):
    return F.regexp_extract(F.col(record), r"^<urn:page:(-?\d+)>$", 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read_warc(archives, payloads=False)
    to_id = lambda c: F.nullif(page_id_of(c), F.lit("")).cast("long")
    return found.select(to_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", to_id("refers_to").alias("refers_to"))
