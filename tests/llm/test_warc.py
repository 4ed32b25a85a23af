"""Archives: written and read back, cut anywhere, damaged, nested, and written by others."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from runloom.llm import warc


def pages_frame(spark, rows):
    """Rows with columns that clash with names used inside."""
    return spark.createDataFrame([(i, u, h, "x", k, "p") for k, (i, u, h) in enumerate(rows)], "page_id long, url string, html string, payload string, start long, path string")


def plain(rows):
    """What the contract says of pages, as (id, bytes, digest, type, refers to)."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in data:
        ids = [k for k, x in data if x == b and k is not None]
        last = max(ids) if len(b) >= 1000 and ids else None
        again = last is not None and i != last
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    found = df.where("record_type <> 'warcinfo'").select(warc.page_of(df["record_id"]).alias("i"), "payload_bytes", "payload_digest", "record_type", warc.page_of(df["refers_to"]).alias("r"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some_pages():
    rng = random.Random(5)
    big = "<p>" + "x y " * 400
    rows = [(i, f"http://h{i % 3}/a b\r\n{i}", "".join(rng.choice("abc <>é漢") for _ in range(rng.choice([0, 10, 999, 1000, 5000])))) for i in range(60)]
    rows += [(100 + i, None, big) for i in range(40)] + [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", big), (139, "again", big), (205, "u", "long " * 100_000)]
    return rows


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 26])
def test_round_trip_whatever_the_ranges(spark, tmp_path, range_bytes):
    rows = some_pages()
    files = warc.write(warc.page_records(pages_frame(spark, rows).repartition(3)), f"file://{tmp_path}/a", archive_bytes=20_000)
    found = warc.index(files, range_bytes)
    assert rows_of(found) == plain(rows)
    assert found.where("NOT intact").count() == 0
    assert found.where("record_type = 'warcinfo'").count() == files.count() > 3
    assert files.agg({"records": "sum"}).first()[0] == len(rows)


def test_listing_and_payloads(spark, tmp_path):
    rows = some_pages()
    folder = f"file://{tmp_path}/a"
    warc.write(warc.page_records(pages_frame(spark, rows)), folder)
    read = warc.payloads(warc.index(warc.archives(spark, folder), 4000)).cache()
    assert {r.payload for r in read.where("record_type = 'revisit'").select("payload").distinct().collect()} == {None}
    whole = warc.resolved(read).where("record_type <> 'warcinfo'").select(warc.page_of(read["record_id"]).alias("i"), "payload").collect()
    assert sorted(((r.i, bytes(r.payload)) for r in whole), key=repr) == sorted(((i, (h or "").encode()) for i, _, h in rows), key=repr)


def test_no_pages_and_empty_files(spark, tmp_path):
    files = warc.write(warc.page_records(pages_frame(spark, [])), f"file://{tmp_path}/a")
    assert files.count() == 0 and warc.index(files).count() == 0
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    assert warc.index(spark.createDataFrame([(f"file://{tmp_path}/empty.warc.gz", 0)], "path string, length long")).count() == 0


def stored(data: bytes) -> bytes:
    z = zlib.compressobj(0, wbits=31)
    return z.compress(data) + z.flush()


def record(name: str, block: bytes, kind: str = "resource", **more: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{name}>"), *((k.replace("_", "-"), v) for k, v in more.items())]
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def indexed(spark, tmp_path, data: bytes, range_bytes: int):
    path = tmp_path / "f.warc.gz"
    path.write_bytes(data)
    return sorted(warc.index(spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long"), range_bytes).collect(), key=lambda r: r.offset)


@pytest.mark.parametrize("range_bytes", [64, 300, 100_000])
def test_archive_inside_of_a_payload_is_not_read(spark, tmp_path, range_bytes):
    inner = b"".join(stored(record(f"in{i}", b"i" * 50)) for i in range(8))
    parts = [stored(record("a", b"first")), stored(record("b", inner)), stored(record("c", inner + inner)), stored(record("d", b"last"))]
    assert [r.record_id for r in indexed(spark, tmp_path, b"".join(parts), range_bytes)] == [f"<urn:{x}>" for x in "abcd"]


@pytest.mark.parametrize("range_bytes", [50, 100_000])
def test_damage_is_left_out_and_what_follows_is_found(spark, tmp_path, range_bytes):
    parts = [gzip.compress(record(x, random.Random(x).randbytes(200))) for x in "abcde"]
    parts[1] = parts[1][:60] + b"\0\0\0" + parts[1][63:]
    parts[3] = parts[3][:-40]
    assert [r.record_id for r in indexed(spark, tmp_path, b"junk" + b"".join(parts) + parts[0][:30], range_bytes)] == ["<urn:a>", "<urn:c>", "<urn:e>"]


def test_headers_of_other_writers(spark, tmp_path):
    body = b"<p>hi"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body
    b32 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
    parts = [
        record("a", http, "response", Content_Type="application/http;msgtype=response", WARC_Payload_Digest=b32),
        record("b", http, "response", Content_Type="application/http", WARC_Payload_Digest="sha1:" + "0" * 40),
        record("c", b"no http head", "response", Content_Type="application/http"),
        record("d", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", "revisit", Content_Type="application/http", WARC_Payload_Digest=b32, WARC_Refers_To="<urn:a>"),
        record("e", b"x" * 3_000_000, "metadata"),
    ]
    got = indexed(spark, tmp_path, b"".join(map(gzip.compress, parts)) + gzip.compress(b"WARC/1.0\r\nbroken\r\n\r\n") + gzip.compress(parts[0] + parts[0]), 1000)
    assert [(r.record_id[5], r.record_type, r.payload_bytes, r.intact) for r in got] == [("a", "response", 5, True), ("b", "response", 5, False), ("c", "response", 12, True), ("d", "revisit", 77, True), ("e", "metadata", 3_000_000, True)]
    assert got[0].payload_digest == got[3].payload_digest == hashlib.sha1(body).hexdigest() and got[3].refers_to == "<urn:a>"


def test_magic_over_block_ends():
    data = b"\0" * (warc.READ - 1) + warc.MAGIC + b"\0" * 10
    f = pa.BufferReader(data)
    assert warc._next_magic(f, 0, len(data)) == warc.READ - 1
    assert warc._next_magic(f, 0, warc.READ - 1) is None
    assert warc._next_magic(f, 0, warc.READ) == warc.READ - 1  # it starts inside and ends outside
    assert warc._next_magic(f, warc.READ, len(data)) is None
