"""WARC archives of pages: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts the files into byte ranges; a task looks for
the gzip magic from the start of its range, takes a place for a member only if it inflates to a
WARC header, and owns the records that start inside its range, however far they reach beyond it. So a
file of any size is read by as many tasks as it has ranges, and a lost task reads its range again.

Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest id is stored and the
others refer to it. Payloads are compared by SHA-1 and length, counted before any page moves. The
repeated digests are broadcast when a count has shown them to be at most ``BROADCAST_ROWS``, and
joined by a shuffle otherwise.

Defined cases: null html is an empty payload; a null url writes no target; rows that repeat the largest
page id of a payload are all responses; a null id ranks below all others and is read back as null;
an empty table writes nothing and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.textcore import SLICE, documents_per_batch, materialize, shared_folder, slices

#: Least payload that is stored once and referred to.
REVISIT_BYTES = 1000
#: Bytes of a range of the reader.
RANGE_BYTES = 8 << 20
#: Repeated digests up to which their table (about 60 bytes a row) is broadcast.
BROADCAST_ROWS = 100_000

#: Fixed values of the formats.
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_PEEK = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z") -> int:
    """Write one archive per task under ``folder`` (a URI); returns the number of records."""
    documents_per_batch(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digests = read.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= revisit_bytes)
    again = digests.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1").select("digest", "size", "target")
    again = materialize(again, "warc-digests")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    marked = read.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html")).join(again, ["digest", "size"], "left")
    marked = marked.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, own, out, n = TaskContext.get().partitionId(), f".{TaskContext.get().taskAttemptId()}.tmp", None, 0
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in slices(batches, "html"):
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{k:05d}.warc.gz{own}")
            for page, url, text, digest, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(record(page, url, text.encode("utf-8"), digest, target, date))
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{base}/{k:05d}.warc.gz{own}", f"{base}/{k:05d}.warc.gz")
            yield pa.record_batch([pa.array([n])], names=["n"])

    return marked.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of one inflated member."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:stop])
        n = int(head["content-length"])
        if len(data) < stop + 4 + n:
            raise ValueError("a record is cut off")
        yield head, data[stop + 4 : stop + 4 + n]
        at = stop + 8 + n


class _Window:
    """Bytes of a file from any place on, read in steps and dropped behind."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + min(n, self.size - at) <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, 1 << 20))
        return self.data[at - self.at : at - self.at + n]


def members(file, size: int, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(place, inflated bytes) of the WARC members that start in [lo, hi)."""
    window, at = _Window(file, size), lo
    while at < hi:
        part = window.get(at, _PEEK)
        k = part.find(_MAGIC)
        if k < 0:
            at += max(1, len(part) - 2)
            continue
        at += k
        if at >= hi:
            return
        try:  # a member that inflates to a WARC header
            if not zlib.decompressobj(31).decompress(window.get(at, _PEEK), 64).startswith(b"WARC/1."):
                raise ValueError
            inflate, parts, to = zlib.decompressobj(31), [], at
            while not inflate.eof and to < size:
                data = window.get(to, _PEEK)
                parts.append(inflate.decompress(data))
                to += len(data)
            data = b"".join(parts)
            if not inflate.eof or b"\r\n\r\n" not in data:
                raise ValueError
        except (zlib.error, ValueError):
            at += 1
            continue
        yield at, data
        at = to - len(inflate.unused_data)


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of all archives under ``folder``: record_id, record_type, url, refers_to, payload (null for revisits), payload_bytes, payload_digest (computed again for responses), path, place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("lo"))
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "lo")
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "path": pa.string(), "place": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    for place, data in members(file, size, lo, min(size, lo + range_bytes)):
                        for head, block in parse_records(data):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
                            if kind == "response":
                                found = hashlib.sha1(payload).hexdigest()
                                if digest and digest != found:
                                    raise ValueError(f"{path} at {place}: the payload's digest is {found}, not {digest}")
                                digest, n = found, len(payload)
                            else:
                                payload, n = None, int(_headers(http).get("content-length", 0))
                            rows.append((head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, payload, n, digest, path, place))
                            held += len(block)
                            if held > SLICE:
                                yield batch_of(rows)
                                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return ranges.mapInArrow(read, "record_id string, record_type string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string, path string, place long")


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write the pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = pages.sparkSession, folder or shared_folder(pages.sparkSession, "warc")
    number = lambda c: F.expr(f"try_cast(nullif(substr({c}, {len(_ID) + 1}), '') AS bigint)")
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not write_warc(pages, folder, **columns):
        return spark.createDataFrame([], out)
    return read_warc(spark, folder).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
