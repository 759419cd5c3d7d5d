"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task writes one archive into the given shared folder through pyarrow's file systems, one gzip member per
record. A file carries a fresh name, and only files named in the tasks' checkpointed results are read, so a task that
ran twice leaves at worst an unread file.

Reader: archives are cut into byte ranges, several to a file. A task scans its range for gzip magic, takes a place as a
member only if the member inflates and its text begins with a WARC version and complete headers, and owns the records
that begin inside its range, reading past the end for the last one. A false magic in compressed data fails the test, and
the scan resumes after each accepted member, so a record is found once whatever the ranges are.

Edge cases: a null payload is empty; equal payloads under `least` bytes are all responses; of equal payloads the smallest
id is the response (rows that repeat that id too), the others revisit it; rows without an id are responses with a null
refers_to; a null URL is written as "urn:none"; an empty table makes no archive and reads as no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint_dir, cut, gentle, map_frames, remove_at_exit

MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
_STEP = 1 << 16
READ_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def record(page_id, url, kind: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit holds no payload, but its digest and length."""
    name = "none" if page_id is None else str(page_id)
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {(url or 'urn:none').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head.insert(4, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict | None:
    """Headers and payload of an inflated record, or None if it is none."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    try:
        text = head.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:  # bytes of another encoding, one character each
        text = head.decode("latin-1")
    lines = text.split("\r\n") if gap and head.startswith(b"WARC/") else []
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    size = fields.get("content-length", "")
    if not size.isdigit() or "warc-type" not in fields or len(rest) < int(size):
        return None
    name = lambda k: fields.get(k, "").removeprefix("<urn:page:").rstrip(">")
    number = lambda x: int(x) if x.lstrip("-").isdigit() else None
    return {
        "page_id": number(name("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": number(name("warc-refers-to")), "payload": rest[: int(size)],
        "payload_bytes": number(fields.get("x-payload-length", size)), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
    }


def _write(folder: str):
    def run(batches):
        fs, base = _filesystem(folder)
        path, out, size = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                payload = as_bytes(row.html)
                first, page = row.first, row.page_id
                kind = "revisit" if first is not None and page is not None and page != first else "response"
                data = record(page, row.url, kind, payload, row.digest, first)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield {"path": [path], "size": [size]}

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """(path, size) of the archives written, one for each task that had rows."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = gentle(pages)
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    # Only digests are shuffled for this; payloads move once, to meet them.
    # Small payloads get a key of their own each, so that all empty pages don't meet in one task.
    key = F.when(F.col("n") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left")
    return cut(map_frames(rows, _write(folder), "path string, size long"))


class _Window:
    """A file read forward in steps, from any place."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at` on; fewer at the end of the file."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.data):
            if not self.start <= at <= self.start + len(self.data):
                self.start, self.data = at, b""
            self.data = self.data[at - self.start :]
            self.start = at
            while len(self.data) < n:
                self.file.seek(self.start + len(self.data))
                more = self.file.read(max(_STEP, n - len(self.data)))
                if not more:
                    break
                self.data += more
        return self.data[at - self.start : at - self.start + n]


def _member(view: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated gzip member at a place and where it ends, if it is one and holds a record."""
    inflate, parts, checked, place = zlib.decompressobj(31), [], False, at
    while not inflate.eof:
        data = view.get(place, _STEP)
        if not data:
            return None
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None
        place += len(data)
        if not checked and sum(map(len, parts)) >= 5:
            if not b"".join(parts).startswith(b"WARC/"):
                return None
            checked = True
    return b"".join(parts), place - len(inflate.unused_data)


def records_in(view: _Window, start: int, end: int):
    """Records that begin in [start, end)."""
    at = start
    while at < end:
        data = view.get(at, _STEP + len(MAGIC) - 1)
        i = data.find(MAGIC)
        if i < 0:
            at += max(len(data) - len(MAGIC) + 1, 1)
            continue
        at += i
        if at >= end:
            return
        got = _member(view, at)
        found = parse(got[0]) if got else None
        if found:
            yield found
            at = got[1]
        else:
            at += 1


def _read(folder: str):
    def run(batches):
        fs, _ = _filesystem(folder)
        for pdf in batches:
            for path, size, start, end in zip(pdf.path, pdf["size"], pdf.start, pdf.end):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for row in records_in(_Window(file, int(size)), int(start), int(end)):
                        rows.append(row)
                        held += len(row["payload"])
                        if held > 8_000_000:
                            yield {name: [r[name] for r in rows] for name in rows[0]}
                            rows, held = [], 0
                if rows:
                    yield {name: [r[name] for r in rows] for name in rows[0]}

    return run


def read_archives(files: DataFrame, folder: str, split_bytes: int = 1 << 20) -> DataFrame:
    """The records of archives given as (path, size); `folder` tells the file system."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("size > 0").select("path", "size", starts.alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("size"), F.col("start") + split_bytes))
    return map_frames(ranges.repartition("path", "start"), _read(folder), READ_COLUMNS)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; removed when the driver ends."""
    return remove_at_exit(spark, f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them back: (page_id, url, record_type, refers_to, payload_bytes, payload_digest).

    Lengths and digests are those of the bytes read, a revisit's those of the response it refers to; a response that is
    missing or differs from what the revisit's header says raises an error. `read_archives` gives the payloads."""
    folder = archive_folder(pages.sparkSession)
    found = read_archives(write_archives(pages, folder), folder)
    found = found.select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("read"), "payload_bytes", "payload_digest")
    found = cut(found)
    response = F.col("record_type") == "response"
    responses = found.where(response).select(F.col("page_id").alias("refers_to"), F.col("read").alias("payload_digest"), "n", "read").distinct()
    again = found.where(~response).drop("n", "read").join(responses, ["refers_to", "payload_digest"], "left")
    again = again.withColumn("n", F.when(F.col("n") == F.col("payload_bytes"), F.col("n")).otherwise(F.raise_error(F.lit("a revisit's response is missing or damaged")).cast("long")))
    return found.where(response).unionByName(again).select("page_id", "url", "record_type", "refers_to", F.col("n").alias("payload_bytes"), F.col("read").alias("payload_digest"))
