"""Operator 6: writing WARC archives and reading them back with a splittable reader.

Writing: each page is one record in one gzip member. The payload digest groups equal payloads;
the page with the smallest id of a group is written as a response with its payload, the others as
revisits that name it. A group's first id is a grouped minimum (combined on the map side) that is
joined back on the digest, so a payload shared by very many pages is split by the planner and
never gathered. Tasks write under the shared folder, each attempt under names of its own; a list
of the files of the attempts that counted is the table of the archive, so a lost or repeated task
leaves at most a file that nothing refers to.

Reading: files are cut into byte ranges, one task row each. A range is searched for gzip magic;
a candidate counts only if it inflates to a WARC version line and a record head of any length. From
there on members follow one another, and a range owns the records that *start* inside it, whatever
their end; the record after its last one is checked as well. Memory is one read buffer and one record.

Defined results: a null html is an empty payload; null ids are larger than all others and are
written as ``null``; rows repeated with the same id and payload are one response and revisits that
refer to that id; payloads shorter than ``min_revisit_bytes`` are all responses; an empty table
gives no file and an empty result. Only id, url and html are read. Urls may hold anything: control
characters are percent-encoded in the head.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabtrail.llm.common import prepare
from tabtrail.session import checkpoint_dir

MIN_REVISIT_BYTES = 0
FILE_BYTES = 256 << 20
SPLIT_BYTES = 32 << 20
MAX_TASKS = 20_000
READ_BYTES = 1 << 20
#: Bytes of a record head that are looked at together.
HEAD_BYTES = 1 << 14
GZIP_LEVEL = 6
#: Repeats of one row written by one task row, so that no repeat count makes a long array.
PIECE_ROWS = 4096
#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<{NAME}{'null' if page_id is None else page_id}>"


def _page_id(name: str | None):
    found = re.fullmatch(rf"<{NAME}(null|-?\d+)>", name or "")
    return int(found[1]) if found and found[1] != "null" else None


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """Bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError if it isn't one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": _page_id(fields.get("WARC-Refers-To"))}


# --- files ------------------------------------------------------------------------------

def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file on the shared storage."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(uri)


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches):
        fs, base = file_system(folder)
        out, path, size, rows = None, None, 0, 0
        done: list[tuple[str, int, int]] = []
        try:
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
                for page_id, url, html, digest, revisit, refers in zip(*cols):
                    if out is None:
                        path, size, rows = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(path, compression=None)
                    data = member(record(page_id, url, (html or "").encode(), digest, refers, revisit), level)
                    out.write(data)
                    size, rows = size + len(data), rows + 1
                    if size >= file_bytes:
                        out.close()
                        done.append((path, size, rows))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.append((path, size, rows))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)],
                                             names=["path", "bytes", "records"])
    return run


def decide(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html",
           min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, revisit, refers_to), one row per page row."""
    prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            raw = [(h or "").encode() for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([payload_digest(x) for x in raw], pa.string()),
                 pa.array([len(x) for x in raw], pa.int64())], names=["page_id", "url", "html", "digest", "size"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(
        run, "page_id bigint, url string, html string, digest string, size bigint")
    # A null id is larger than all others: it is first only if there is no other.
    same_id = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n")))
    first = (same_id.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("f"),
                                           F.sum("n").alias("rows"))
             .where("rows > 1")
             .select(F.col("digest").alias("d"), F.col("f.page_id").alias("first"), F.col("f.n").alias("n_first")).checkpoint())
    joined = rows.join(first, (rows.digest == first.d) & (rows["size"] >= min_revisit_bytes), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    revisit = F.col("d").isNotNull() & ~is_first
    plain = joined.where(F.col("d").isNull() | ~is_first | (F.col("n_first") == 1)).select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))
    if first.where("n_first > 1").isEmpty():
        return plain
    # Rows repeated with the first id: one response, the rest revisits of it.
    again = (joined.where(F.col("d").isNotNull() & is_first & (F.col("n_first") > 1))
             .groupBy("digest", "page_id").agg(F.min("url").alias("url"), F.first("html").alias("html"), F.count("*").alias("n"))
             .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PIECE_ROWS))))
             .repartition("digest", "page_id", "piece")
             .select("page_id", "url", "html", "digest", F.explode(F.sequence(
                 F.col("piece") * PIECE_ROWS + 1, F.least(F.col("n"), (F.col("piece") + 1) * PIECE_ROWS))).alias("i")))
    again = again.select("page_id", "url", "html", "digest", (F.col("i") > 1).alias("revisit"),
                         F.when(F.col("i") > 1, F.col("page_id")).alias("refers_to"))
    return plain.unionByName(again)


def write_archives(pages: DataFrame, folder: str | None = None, *, file_bytes: int = FILE_BYTES,
                   level: int = GZIP_LEVEL, **columns) -> DataFrame:
    """Write one record per page row under ``folder`` (by default a new one in the shared
    checkpoint folder) and return the table of its files: path, bytes, records."""
    spark = prepare(pages.sparkSession)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, base = file_system(folder)
    fs.create_dir(base + "/data", recursive=True)
    decided = decide(pages, **columns)
    made = decided.mapInArrow(_writer(folder + "/data", file_bytes, level), "path string, bytes bigint, records bigint")
    made.write.parquet(folder + "/files")
    return spark.read.parquet(folder + "/files")


# --- splittable reader ---------------------------------------------------------------------

class Range:
    """Buffered bytes of a file from an offset on."""

    def __init__(self, f, at: int):
        self.f, self.at, self.held = f, at, b""
        f.seek(at)

    def more(self) -> bool:
        data = self.f.read(READ_BYTES)
        self.held += data
        return bool(data)

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _is_record(src: Range, i: int) -> bool:
    """Whether the bytes at position ``i`` of the buffer inflate to a record head, however long it is."""
    z, head, at = zlib.decompressobj(31), b"", i
    typed, left = False, b""
    try:
        while True:
            if not left:
                if at >= len(src.held) and not src.more():
                    return False
                left, at = src.held[at:], len(src.held)
            head += z.decompress(left, HEAD_BYTES)
            left = z.unconsumed_tail
            if not head.startswith(VERSION[:min(len(head), 7)]):
                return False
            end = head.find(b"\r\n\r\n")
            typed = typed or 0 <= head.find(b"\r\nWARC-Type: ") and (end < 0 or head.find(b"\r\nWARC-Type: ") < end)
            if end >= 0 or z.eof:
                return typed and end >= 0
            if len(head) > 2 * HEAD_BYTES:      # what may still begin one of the marks looked for
                head = head[:len(VERSION)] + head[-32:]
    except zlib.error:
        return False


def _first_record(src: Range, end: int) -> bool:
    """Move to the first record that starts before ``end``."""
    while src.at < end:
        i = src.held.find(MAGIC)
        if i < 0:
            src.skip(max(0, len(src.held) - len(MAGIC) + 1))
            if not src.more():
                return False
            continue
        if src.at + i >= end:
            return False
        if _is_record(src, i):
            src.skip(i)
            return True
        src.skip(i + 1)
    return False


def read_range(f, start: int, end: int, whole: bool = False):
    """Records of an archive file that start in [start, end). A record is followed by a record or the end of the file:
    the reader of a range checks this for the record after its last one too, so a record that cannot be read is an
    error and never skipped by the next range's search. ``whole``: the file begins with a record, checked as well."""
    src = Range(f, start)
    if whole and start == 0 and src.more() and not _is_record(src, 0):
        raise ValueError("the file does not begin with a WARC record")
    if not _first_record(src, end):
        return
    while src.at < end:
        if not src.held and not src.more():
            return
        z, data = zlib.decompressobj(31), []
        while True:
            data.append(z.decompress(src.held))
            used = len(src.held) - len(z.unused_data)
            src.skip(used)
            if z.eof:
                break
            if not src.more():
                raise ValueError("archive ends inside a record")
        yield parse(b"".join(data))
    if (src.held or src.more()) and not _is_record(src, 0):
        raise ValueError("no WARC record after the last one of a range")


def read_archives(files: DataFrame, *, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archive files in ``files`` (path, bytes): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and the payload if asked for."""
    prepare(files.sparkSession)
    splits = files.where("bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"), "bytes").select(
        "path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    limit = 1 << 24

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                fs, p = file_system(path)
                with fs.open_input_file(p) as f:
                    for r in read_range(f, start, end, True):
                        rows.append(r if with_payload else {n: r[n] for n in names})
                        held += 200 + (len(r["payload"] or b"") if with_payload else 0)
                        if held > limit:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    schema = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint" + ", payload binary" * with_payload)
    # an explicit number of tasks: the ranges are a few bytes each, and adaptive coalescing
    # would put them all into one
    pieces = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return splits.repartition(max(1, min(int(pieces), MAX_TASKS))).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    return read_archives(write_archives(pages, **columns))
