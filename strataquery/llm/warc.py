"""WARC archives with every record its own gzip member.

Pages are first written as monolithic archives (one gzip stream over a whole file). The normaliser inflates each such
file once, as a stream, rewrites every record as its own member and writes a sidecar index of offsets; the reader seeks
to each record by that index. Files are written under a temporary name and then moved, so a task run twice does no harm.

Of records with equal payloads (of at least `least` bytes) the one with the largest page_id is the response and the
others are revisits of it.

Edge cases: null html is an empty payload; rows that share the largest page_id of equal payloads are all responses; a
null page_id sorts below every number (and stays null when read back), and where all are null each is a response; line
breaks in a url are percent-encoded, a null url gives no target header; repeated rows are records of their own; a very
long payload is held once by the task that writes or reads it; an empty table gives empty archives and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.llm.common import delete, fresh_path, skewed_join, stored

CHUNK = 1 << 20
#: Revisits that are broadcast; where a count shows more, pages and revisits are shuffled by page.
COPIED = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    value = urn[len("<urn:x-page:") : -1]
    return None if value == "null" else int(value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit_of is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if revisit_of is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit_of is not None:
        lines += [f"WARC-Refers-To: {_urn(revisit_of)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def _moved(fs: pafs.FileSystem, path: str, write) -> None:
    """Writes a file under a name of this attempt, then moves it to its place."""
    at = TaskContext.get()
    tmp = f"{path}.{at.attemptNumber() if at else 0}-{at.taskAttemptId() if at else 0}.tmp"
    with fs.open_output_stream(tmp, compression=None) as out:
        write(out)
    fs.move(tmp, path)


def _root(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    return fs, root


def write_monolithic(rows: DataFrame, uri: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One archive for each partition of rows (page_id, url, html, sha1, revisit_of); returns their paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _root(uri)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def records(out) -> None:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            for b in batches:
                for r in b.to_pylist():
                    payload = (r["html"] or "").encode("utf-8")
                    out.write(z.compress(warc_record(r["page_id"], r["url"], payload, base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["revisit_of"], date)))
            out.write(z.flush())

        _moved(fs, path, records)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return rows.mapInArrow(write, "path string")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, as they come."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            else:
                break


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream; holds one record and a chunk."""
    held, need, seen = bytearray(), None, 0
    for part in parts:
        held += part
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    break
                need = end + 4 + int(_headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, seen = None, 0
    if held:
        raise ValueError(f"the archive ends inside a record: {bytes(held[:80])!r}")


def _spread(paths: DataFrame) -> DataFrame:
    """As many tasks as archives: the rows are short, and adaptive planning would put them all into one."""
    return paths.repartition(max(1, paths.count()), "path")


def normalise(paths: DataFrame, uri: str, target: str) -> DataFrame:
    """Rewrites archives so that each record is a member of its own, with a sidecar .idx of JSON lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _root(uri)
        _, out_root = _root(target)
        for b in batches:
            for path in b.column(0).to_pylist():
                out_path, index = f"{out_root}/{path.rsplit('/', 1)[1]}", []

                def members(out, path=path, index=index) -> None:
                    offset = 0
                    with fs.open_input_stream(path, compression=None) as raw:
                        for record in split_records(inflated(raw)):
                            z = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = z.compress(record) + z.flush()
                            out.write(member)
                            head = _headers(record[: record.index(b"\r\n\r\n")])
                            index.append(json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "offset": offset, "length": len(member)}))
                            offset += len(member)

                _moved(fs, out_path, members)
                _moved(fs, out_path + ".idx", lambda out, index=index: out.write("".join(x + "\n" for x in index).encode()))
                yield pa.RecordBatch.from_pydict({"path": [out_path]})

    return _spread(paths).mapInArrow(run, "path string")


def read_archives(paths: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """Rows of normalised archives: every record is sought by its offset in the sidecar index and inflated alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _root(uri)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path + ".idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for at in index:
                        f.seek(at["offset"])
                        record = zlib.decompress(f.read(at["length"]), 31)
                        cut = record.index(b"\r\n\r\n")
                        head, block = _headers(record[:cut]), record[cut + 4 : -4]
                        http, _, body = block.partition(b"\r\n\r\n")
                        full = int(_headers(http)["content-length"])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(body) != full or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{path}: record {at['id']} doesn't match its digest")
                        refers = head.get("warc-refers-to")
                        rows.append((_id(head["warc-record-id"]), full, digest, head["warc-type"], _id(refers) if refers else None, head.get("warc-target-uri"), body if payloads else None))
                        if len(rows) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return _spread(paths).mapInArrow(run, READ_SCHEMA)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, sha1 and revisit_of (null for responses). Only ids and digests meet by digest: a payload that
    a third of the rows share costs short rows, and the html itself moves not at all, or once, dealt by page, where there are many revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
    seen = stored(keyed.where(F.col("n") >= least).distinct(), "warc-digests")
    lead = stored(seen.groupBy("sha1", "n").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("held")), "warc-leads")
    roles = skewed_join(seen, lead, ["sha1", "n"], "held", seen.count()).where("lead IS NOT NULL AND NOT page_id <=> lead").select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "lead")
    roles = stored(roles, "warc-revisits")
    roles = F.broadcast(roles) if roles.count() <= COPIED else roles
    own = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha1"))
    return own.join(roles, own.page_id.eqNullSafe(roles._id) & (own.sha1 == roles._sha1), "left").select("page_id", "url", "html", "sha1", F.col("lead").alias("revisit_of"))


def archive(pages: DataFrame, least: int = 0, target: str | None = None) -> tuple[DataFrame, str]:
    """Writes normalised archives of pages (page_id, url, html); returns their paths and the folder.

    The folder is `target`, which the caller owns and keeps; without one, a new folder in the shared one, which is deleted
    when the driver's Python ends."""
    spark = pages.sparkSession
    raw, out = fresh_path(spark, "warc-raw"), target or fresh_path(spark, "warc")
    written = stored(write_monolithic(with_revisits(pages, least).sortWithinPartitions("page_id"), raw), "warc-paths")
    done = stored(normalise(written, raw, out), "warc-paths")
    delete(spark, raw)
    return done, out


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, uri = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(paths, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A digest's 160 bits as base32: each of 32 letters from two of its hexadecimal digits.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p), l AS (SELECT s, max(page_id) AS lead FROM d GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(5 * i // 4 AS INTEGER) + 1, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM d JOIN l USING (s)
"""
