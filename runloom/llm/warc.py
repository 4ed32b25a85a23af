"""WARC archives: written one gzip member a record, read back by byte ranges.

A file is cut into ranges of fixed size, and a task owns the records that start inside its range. It looks
for gzip's magic number, decodes the candidate and takes it only if it inflates whole, with a right checksum,
to one record with the headers that every record must have. From there it goes from member to member; the
last one may end behind the range.

A payload may itself be an archive that was stored without compression, and a scan that begins inside of it would
find members that are none. So ranges tell where their first member started and their last one ended, and
the two must meet: a range whose start isn't where the chain of the ranges before it arrives is read again from there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed

#: Bytes of a range, of a read, of the headers of a record at most, and of an archive before the next one is begun.
RANGE, READ, HEADERS, ARCHIVE = 64 << 20, 1 << 20, 1 << 20, 1 << 30
MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on are written once and revisited by the others.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "path string, start long, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, intact boolean, came_from long, goes_to long"
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri), safe=":/@[]%"))


# writing


def _http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member. Control characters and blanks of a header's value are percent-encoded, null ones left out."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = [f"{k}: {v if k == 'Content-Type' else clean(v)}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    z = zlib.compressobj(6, wbits=31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``: the records of pages.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``revisit_from`` bytes those
    with the largest page id are responses and the others revisits of it, whose payload is null here; rows without a
    page id revisit it too, and where none has one all are responses. Only digests are grouped; texts move once, spread by
    page id and digest.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.sha2("payload", 256).alias("same"))
    narrow = rows.drop("payload").where(F.col("payload_bytes") >= revisit_from)
    last = narrow.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    last = last.select("same", "last").repartition("same", "last")  # so that the join can split a frequent payload
    again = narrow.join(last, "same").where("NOT page_id <=> last")
    known = again.select(F.col("page_id").alias("again_id"), F.col("same").alias("again_same")).distinct()
    first = rows.join(known, rows["page_id"].eqNullSafe(known["again_id"]) & (rows["same"] == known["again_same"]), "left_anti")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    responses = first.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(again.withColumn("payload", F.lit(None).cast("binary")).select(*columns, F.lit("revisit").alias("record_type"), F.col("last").alias("refers_to")))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record_id: Column) -> Column:
    """The page id that a record id of :func:`write` carries."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("long")


def write(records: DataFrame, folder: str, date: str | None = None, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write ``records`` (see :func:`page_records`) below ``folder``; gives ``path, length, records`` of the archives.

    Every attempt of a task writes files of its own. Those of attempts that count are listed in ``folder/manifest``,
    written by Spark's committer; files of lost attempts aren't listed and never read. Empty tasks write nothing.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, length, count = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([count], pa.int64())], names=["path", "length", "records"])

        for b in batches:
            for page, url, payload, size, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, length, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, at = _open(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    length += len(info)
                again = kind == "revisit"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
                headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, digest))] if again else []
                one = member([*headers, ("Content-Type", "application/http; msgtype=response")], _http_head(size) + (b"" if again else payload))
                out.write(one)
                length, count = length + len(one), count + 1
                if length >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    columns = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    columns.mapInArrow(run, "path string, length long, records long").write.mode("errorifexists").parquet(f"{folder}/manifest")
    return records.sparkSession.read.parquet(f"{folder}/manifest")


def archives(spark, folder: str) -> DataFrame:
    """``path, length`` of the ``.warc.gz`` files below a folder, listed by Spark without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", "length")


# reading


class Damaged(ValueError):
    """What starts here isn't a whole record of its own."""


class _Inflated:
    """Bytes of the gzip member that starts at ``at``, inflated as they are asked for."""

    def __init__(self, f: pa.NativeFile, at: int) -> None:
        self.f, self.at, self.z, self.held, self.fed = f, at, zlib.decompressobj(31), b"", 0
        f.seek(at)

    def more(self) -> bool:
        """Inflate some more; false at the end of the member."""
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail
        if not raw:
            raw = self.f.read(READ if self.fed else 16 << 10)
            self.fed += len(raw)
        try:
            out = self.z.decompress(raw, READ)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if not raw and not out and not self.z.eof:
            raise Damaged("cut off")
        self.held += out
        return True

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """What stands before ``mark``, which is taken too; None if it isn't among the next ``limit`` bytes."""
        seen = 0
        while (i := self.held.find(mark, max(0, seen - len(mark)))) < 0 or i > limit:
            seen = len(self.held)
            if seen > limit or not self.more():
                return None
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise Damaged("block too short")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> int:
        """Where the member ends, after the two line ends that close a record."""
        while len(self.held) <= 4 and self.more():
            pass
        if self.held != b"\r\n\r\n" or not self.z.eof:
            raise Damaged("no end of record")
        return self.at + self.fed - len(self.z.unused_data)


def _fields(text: bytes) -> dict[str, str]:
    found = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", text).split(b"\r\n"):  # a value may go on in the next line
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("headers")
        found.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return found


def _hex(digest: str | None) -> str | None:
    """A declared SHA-1 as bare hex digits; archives write it in hex or base 32."""
    kind, _, value = (digest or "").rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def read_member(f: pa.NativeFile, at: int, with_payload: bool = False) -> dict:
    """The record whose member starts at ``at``; :class:`Damaged` if there is none.

    The payload of an HTTP message is what follows its head, else the whole block. It is hashed as it is inflated and
    held only if asked for. A revisit has no payload: its size and digest are those it declares.
    """
    z = _Inflated(f, at)
    while len(z.held) < 7 and z.more():
        pass
    if not z.held.startswith(b"WARC/1."):
        raise Damaged("not a record")
    head = z.until(b"\r\n\r\n", HEADERS)
    if head is None:
        raise Damaged("headers")
    fields = _fields(head.partition(b"\r\n")[2])
    size = fields.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", size) or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Damaged("headers")
    size, kind = int(size), fields["warc-type"].lower()
    http, skipped = {}, 0
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        while len(z.held) < min(size, HEADERS) and b"\r\n\r\n" not in z.held[:size] and z.more():
            pass
        i = z.held[: min(size, HEADERS)].find(b"\r\n\r\n")
        if i >= 0:
            try:
                http, skipped = _fields(z.held[:i].partition(b"\r\n")[2]) if b"\r\n" in z.held[:i] else {}, i + 4
            except Damaged:
                skipped = 0
    for _ in z.take(skipped):
        pass
    sha, pieces = hashlib.sha1(), []
    for piece in z.take(size - skipped):
        sha.update(piece)
        if with_payload:
            pieces.append(piece)
    end = z.end()
    declared = _hex(fields.get("warc-payload-digest"))
    n, digest, intact = size - skipped, sha.hexdigest(), True
    if kind == "revisit":
        told = http.get("content-length", "")
        n, digest = (int(told) if re.fullmatch(r"\d{1,18}", told) else None), declared
    elif declared is not None:
        intact = declared == digest
    out = {"offset": at, "length": end - at, "record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    out |= {"payload_bytes": n, "payload_digest": digest, "intact": intact}
    return out | ({"payload": b"".join(pieces) if kind != "revisit" else None} if with_payload else {})


def _next_magic(f: pa.NativeFile, at: int, end: int) -> int | None:
    """The first place from ``at`` on, before ``end``, where gzip's magic number stands."""
    while at < end:
        f.seek(at)
        block = f.read(min(READ, end - at + len(MAGIC) - 1))
        i = block.find(MAGIC)
        if i >= 0:
            return at + i if at + i < end else None
        if len(block) < len(MAGIC):
            return None
        at += len(block) - len(MAGIC) + 1
    return None


def scan_range(f: pa.NativeFile, start: int, end: int, known: int | None) -> Iterator[dict]:
    """Records that start in a range, then one row of where their chain began and where it goes.

    ``known`` is where a member starts for sure; else one is looked for. Where the chain breaks (damage), the scan
    looks for the next member, and ``goes_to`` is null if none follows in the range.
    """
    at, came_from, goes_to = known, known, None
    if at is None:
        at = _next_magic(f, start, end)
    while at is not None and at < end:
        try:
            one = read_member(f, at)
        except Damaged:
            goes_to, at = None, _next_magic(f, at + 1, end)
            continue
        came_from = at if came_from is None else came_from
        at = goes_to = at + one["length"]
        yield one
    yield {"came_from": came_from, "goes_to": goes_to}


def _scan(range_bytes: int):
    schema = pa.schema([pa.field(name, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for path, size, start, known in zip(*(c.to_pylist() for c in b.columns)):
                store, at = _open(path)
                with store.open_input_file(at) as f:
                    for row in scan_range(f, start, min(size, start + range_bytes), known):
                        held.append({"path": path, "start": start} | row)
                        if len(held) == 1024:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def index(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``path, offset, length, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, intact`` of
    every record in ``files`` (``path``, ``length``).

    ``offset`` and ``length`` are those of the gzip member, digests bare hex SHA-1, worked out from the payload;
    ``intact`` tells whether a declared one is the same. Records of a damaged stretch are left out, and those
    behind it found again. Empty files have none. Ranges are checked against each other (see the module); one that began
    inside a payload is read again. A store must be one that Arrow opens.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", F.col("length").alias("size"), starts.alias("start"))
    ranges = ranges.withColumn("known", F.when(F.col("start") == 0, F.lit(0).cast("long")))
    tasks = -(-(files.agg(F.sum("length")).first()[0] or 0) // max(range_bytes, READ))
    spread = lambda df: df.repartition(max(1, tasks), "path", "start")
    read = lambda df: checkpointed(spread(df.select("path", "size", "start", "known")).mapInArrow(_scan(range_bytes), INDEX))
    found = read(ranges)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        links = found.where("record_type IS NULL").select("path", "start", "came_from", F.last("goes_to", True).over(before).alias("due"))
        end = F.col("start") + range_bytes
        wrong = F.when(F.col("due") < F.col("start"), F.lit(False)).when(F.col("due") >= end, F.col("came_from").isNotNull()).otherwise(~F.col("came_from").eqNullSafe(F.col("due")))
        again = checkpointed(links.where("due IS NOT NULL").where(wrong).select("path", "start", "due"))
        if not again.count():
            break
        kept = found.join(again, ["path", "start"], "left_anti")
        inside = again.where(F.col("due") < end).join(ranges.drop("known"), ["path", "start"]).select("path", "size", "start", F.col("due").alias("known"))
        none = again.where(F.col("due") >= end).select("path", "start")
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in INDEX.split(", ")[2:])]
        found = checkpointed(kept.unionByName(read(inside)).unionByName(none.select("path", "start", *empty)))
    return found.where("record_type IS NOT NULL").drop("start", "came_from", "goes_to")


def payloads(indexed: DataFrame) -> DataFrame:
    """``indexed`` with ``payload``: the bytes, read at each record's place. Those of revisits are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            for i, (name, at) in enumerate(zip(b.column("path").to_pylist(), b.column("offset").to_pylist())):
                if name != path:
                    store, place = _open(name)
                    path, f = name, store.open_input_file(place)
                found = pa.array([read_member(f, at, with_payload=True)["payload"]], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, found], names=[*b.schema.names, "payload"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in indexed.dtypes)
    return indexed.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, f"{kinds}, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Rows of :func:`payloads` in which a revisit has the payload of the record that it refers to (null if there is none)."""
    first = records.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload").alias("payload"))
    again = records.where("record_type = 'revisit'").drop("payload").join(first, "refers_to", "left")
    return records.where("record_type <> 'revisit'").unionByName(again)
