import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from paircraft.llm import warc
from paircraft.session import ensure_checkpoint_dir


def brute(rows, min_bytes=0):
    first = {}
    for p, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= min_bytes and first.get(h or "") != p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(map(str, out))


ROWS = [(1, "x" * 5000), (2, "a"), (3, None), (4, ""), (5, "a"), (6, "é\r\n\r\nWARC/1.1\r\n"), (7, "x" * 5000),
        (5, "a"), (1, "x" * 5000), (8, "b" * 64), (9, "ñ" * 33)]


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(p, f"http://h/{p}\nx", h, "t") for p, h in ROWS],
                                  "page_id bigint, url string, html string, record_type string")
    got = warc.round_trip(pages, min_bytes=min_bytes).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS, min_bytes)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert sorted(str(tuple(r)) for r in warc.round_trip(pages).collect()) == brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_carry_payload_and_digests(spark):
    pages = spark.createDataFrame([(p, None, h) for p, h in ROWS], "page_id bigint, url string, html string")
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    archives = warc.write_archives(pages, folder, min_bytes=10**6)
    rows = warc.read_chunks(spark, archives, chunk=32).collect()
    assert max(len(r.data) for r in rows) <= 32
    by = {}
    for r in rows:
        by.setdefault((r.archive, r.record_id, r.page_id), []).append(r)
    for (_, _, page), rs in by.items():
        text = (dict(ROWS)[page] or "").encode()
        if sum(p == page for p, _ in ROWS) > 1:
            continue
        rs.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in rs] == list(range(len(rs))) and [r.last for r in rs] == [False] * (len(rs) - 1) + [True]
        assert b"".join(bytes(r.data) for r in rs) == text
        at = 0
        for r in rs:
            at += len(r.data)
            assert r.bytes_so_far == at and r.digest_so_far == warc.base32_sha1(hashlib.sha1(text[:at]).digest())
