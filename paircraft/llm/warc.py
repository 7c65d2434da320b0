"""WARC archives written and read by Spark tasks.

Writing: the digest of every payload is found first (SHA-1, JVM-side); of
records with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id is a response, the others are revisits that refer to it; smaller
payloads are all responses. Each task writes the records of its partition to
one archive in the shared folder, under a temporary name that is renamed when
the file is whole, so a task that is run again replaces its own file only.

Reading: an archive is a stream of records. The reader takes blocks of
``chunk`` bytes, and a record becomes rows (archive, record, chunk_no, data)
that carry the payload's bytes and SHA-1 so far; the row marked ``last`` has
the whole payload's. No record is ever held whole.

Null payloads are empty. Rows with the same id and payload are all responses if
theirs is the smallest id; a null id counts as larger than any other. An empty
table makes archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paircraft.llm.common import n_parts
from paircraft.session import ensure_checkpoint_dir

MIN_BYTES = 0
CHUNK = 1 << 20
LEVEL = 1
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs
CHUNKS = ("archive string, record_id string, page_id bigint, record_type string, refers_to bigint, "
          "declared_digest string, declared_bytes bigint, chunk_no bigint, data binary, bytes_so_far bigint, "
          "digest_so_far string, last boolean")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, sha, n_bytes, record_type, refers_to), one row per distinct id and
    payload. Hot payloads: the smallest id of a payload is found with partial
    aggregation, and the join back is of narrow rows that AQE may split."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha1(payload).alias("sha"),
                         F.octet_length(payload).cast("bigint").alias("n_bytes")).distinct()
    first = keyed.groupBy("sha").agg(F.min("id").alias("first_id"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    return keyed.join(first, "sha").select(
        "id", "sha", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def header_lines(pairs: list[tuple[str, object]]) -> bytes:
    return VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in pairs if v is not None) + CRLF


def one_line(value: str | None) -> str | None:
    """A header's value: white space that would end the line becomes a space."""
    return None if value is None else " ".join(value.split())


class Member:
    """One gzip member of an archive, compressed as it is written."""

    def __init__(self, out):
        self.out, self.z = out, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.out.write(self.z.compress(data))

    def __enter__(self) -> Member:
        return self

    def __exit__(self, *_) -> None:
        self.out.write(self.z.flush())


def write_record(out, page_id, url, payload: bytes, sha_hex: str, kind: str, refers_to, chunk: int) -> None:
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8",
                      b"Content-Length: %d" % len(payload)]) + CRLF + CRLF
    body = len(payload) if kind == "response" else 0
    out.write(header_lines([
        ("WARC-Type", kind), ("WARC-Record-ID", record_urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(sha_hex))),
        ("WARC-Refers-To", record_urn(refers_to) if kind == "revisit" else None),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to), ("X-Payload-Bytes", len(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + body)]))
    out.write(http)
    view = memoryview(payload)
    for i in range(0, body, chunk):
        out.write(view[i:i + chunk])
    out.write(CRLF + CRLF)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> list[str]:
    """Write every row as a WARC record; returns the archives' paths (one per
    partition). ``folder`` is a URI that all executors reach."""
    types = record_types(pages, id_col, payload_col, min_bytes)
    d = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("sha", F.sha1("payload"))
    t = types.select(F.col("id").alias("t_id"), F.col("sha").alias("t_sha"), "record_type", "refers_to")
    rows = d.join(t, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("sha") == F.col("t_sha"))).select(
        "id", "url", "payload", "sha", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}.warc.gz"
        tmp, n = f"{base}/_{name}.{ctx.taskAttemptId()}", 0
        with where.open_output_stream(tmp) as out:
            with Member(out) as m:
                m.write(header_lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"),
                                      ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Length", 0)]) + CRLF + CRLF)
            for b in batches:
                for i in range(b.num_rows):
                    page, url, payload, sha, kind, ref = (c[i] for c in b.columns)
                    with Member(out) as m:
                        write_record(m, page.as_py(), url.as_py(), payload.as_buffer(), sha.as_py(), kind.as_py(),
                                     ref.as_py(), chunk)
                    n += 1
        where.move(tmp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n"])

    done = rows.mapInArrow(run, "path string, n bigint").collect()  # one row per partition
    return sorted(r.path for r in done)


class Stream:
    """Buffered reader of one archive that holds a chunk and a header line at most."""

    def __init__(self, file, chunk: int):
        self.file, self.chunk, self.buffer, self.at = file, chunk, b"", 0

    def _fill(self) -> bool:
        more = self.file.read(self.chunk)
        self.buffer, self.at = self.buffer[self.at:] + more, 0
        return bool(more)

    def line(self) -> bytes:
        while (end := self.buffer.find(CRLF, self.at)) < 0:
            if not self._fill():
                end = len(self.buffer)
                break
        out, self.at = self.buffer[self.at:end], min(end + 2, len(self.buffer))
        return out

    def more(self) -> bool:
        return self.at < len(self.buffer) or self._fill()

    def headers(self) -> dict[bytes, bytes]:
        out = {}
        while line := self.line():
            k, _, v = line.partition(b":")
            out[k.strip().lower()] = v.strip()
        return out

    def block(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, at most a chunk at a time."""
        while n:
            if not self.more():
                raise EOFError("an archive ends inside a record")
            part = self.buffer[self.at:self.at + min(n, self.chunk)]
            self.at += len(part)
            n -= len(part)
            yield part


def read_records(file, archive: str, chunk: int) -> Iterator[tuple]:
    """Chunk rows of one archive, in order."""
    s = Stream(file, chunk)
    while s.more():
        first = s.line()
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record where one should begin")
        h = s.headers()
        left = int(h[b"content-length"])
        kind = h[b"warc-type"].decode()
        if kind in ("response", "revisit"):
            status = s.line()
            http = s.headers()
            # the block's HTTP head as it was read: lines, separators and the empty line
            head = len(status) + 2 + sum(len(k) + len(v) + 4 for k, v in http.items()) + 2
            number = lambda k: int(h[k]) if k in h else None
            row = (archive, h[b"warc-record-id"].decode(), number(b"x-page-id"), kind, number(b"x-refers-to-page-id"),
                   h[b"warc-payload-digest"].decode().removeprefix("sha1:"), number(b"x-payload-bytes"))
            sha, n, no, left = hashlib.sha1(), 0, 0, left - head
            if not left:
                yield (*row, 0, b"", 0, base32_sha1(sha.digest()), True)
            for part in s.block(left):
                sha.update(part)
                n += len(part)
                yield (*row, no, part, n, base32_sha1(sha.digest()) if n == left else base32_sha1(sha.copy().digest()),
                       n == left)
                no += 1
        else:
            for _ in s.block(left):
                pass


def read_chunks(spark: SparkSession, archives: list[str], chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk table of the archives, one archive per task; ``with_data=False``
    leaves the bytes out, when only digests and lengths are asked for."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
             pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                where, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with where.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for r in read_records(f, path, chunk):
                        rows.append(r if with_data else (*r[:8], None, *r[9:]))
                        held += len(r[8]) if with_data else 0
                        if held >= 4 * chunk or len(rows) >= 1000:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    paths = spark.createDataFrame([(i, p) for i, p in enumerate(archives)], "at int, path string")
    return paths.repartitionById(max(1, len(archives)), F.col("at")).select("path").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: length, digest, type, reference. A revisit holds no
    payload, so its length and digest are those that its headers declare."""
    whole = chunks.where("last")
    got = lambda held, declared: F.when(F.col("record_type") == "revisit", F.col(declared)).otherwise(F.col(held))
    return whole.select("page_id", got("bytes_so_far", "declared_bytes").alias("payload_bytes"),
                        got("digest_so_far", "declared_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, folder: str | None = None) -> DataFrame:
    """Write the archives below the session's shared folder and read them back."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, min_bytes=min_bytes)
    return records(read_chunks(spark, archives, with_data=False))
