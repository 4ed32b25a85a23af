"""Secret scans over an incremental blob ledger.

Every distinct text is a blob, addressed by its SHA-256. The ledger lists the (blob, rule version)
pairs that were scanned; a run scans only the pairs that aren't in it and joins the findings of both
back to every path (row) that holds the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed

#: Changes whenever a rule changes, so that blobs are scanned anew.
RULES_VERSION = "2025-2"
#: Kinds in the order in which ties are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "bearer", "jwt", "prefixed", "url")
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # greedy runs: the same as all runs, the short ones dropped
#: Encapsulation boundaries of textual encodings whose label ends in PRIVATE KEY (RFC 7468), and what can't lie between.
_PEM = re.compile(rb"-----(BEGIN|END)\x20((?:[A-Z0-9]+\x20)*)PRIVATE\x20KEY-----")
_UNPRINTED = re.compile(rb"[^\x09-\x0D\x20-\x7E]")
_BEARER = re.compile(rb"bearer\x20+([A-Za-z0-9+/_.~=-]{20,})", re.I)
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
_PREFIXED = re.compile(rb"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})")
#: An address with a password, from its colon on; the scheme is read back from there.
_USER = re.compile(rb"://[^\x00-\x20/:@\"']+:[^\x00-\x20/@\"']+@")
_SCHEME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Up to so many names of unseen blobs travel to the texts; beyond them the texts are shuffled to the names.
SENT_BLOBS = 500_000
_NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _private_keys(t: bytes) -> Iterator[tuple[int, int, int]]:
    """Blocks from a BEGIN to the next END of the same label, no other BEGIN between; each byte is read once."""
    begin = None
    for m in _PEM.finditer(t):
        if m[1] == b"BEGIN":
            begin = m
        elif begin is not None:
            if m[2] == begin[2] and not _UNPRINTED.search(t, begin.end(), m.start()):
                yield begin.start(), 3, m.end()
            begin = None


def _addresses(t: bytes) -> Iterator[tuple[int, int, int]]:
    """Addresses with a user and a password; a scheme is read back to its first letter, no further than the last mark."""
    last = 0
    at = t.find(b"://")
    while at >= 0:
        if m := _USER.match(t, at):
            start = at
            while start > last and t[start - 1] in _SCHEME:
                start -= 1
            while start < at and not chr(t[start]).isalpha():
                start += 1
            if start < at:
                yield start, 7, m.end()
        last = at + 3
        at = t.find(b"://", last)


def find(text: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret in UTF-8 ``text``, in code points, by start and then kind."""
    t = text or b""
    low = t.lower()
    found: list[tuple[int, int, int]] = []
    if any(n in low for n in _NEEDLES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 12]
    if b"AKIA" in t:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(t)]
    if b"-----BEGIN " in t:
        found += _private_keys(t)
    if b"bearer" in low:
        found += [(m.start(), 4, m.end()) for m in _BEARER.finditer(t)]
    if b"eyJ" in t:
        found += [(m.start(), 5, m.end()) for m in _JWT.finditer(t)]
    if any(n in t for n in (b"gh", b"xox", b"sk_live_", b"AIza")):
        found += [(m.start(), 6, m.end()) for m in _PREFIXED.finditer(t)]
    if b"://" in t:
        found += _addresses(t)
    if not found:
        return []
    found.sort()
    if len(t) == len(low) and not t.isascii():
        at = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        place = lambda p: int(at[p - 1]) if p else 0
        return [(KINDS[k], place(a), place(b)) for a, k, b in found]
    return [(KINDS[k], a, b) for a, k, b in found]


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, blob)`` of each row; null counts as the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for b in batches:
        keep = []
        for x in b.column(0).to_pylist():
            keep.append(x not in seen)
            seen.add(x)
        yield b.filter(pa.array(keep, pa.bool_()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        blobs, found = [], []
        for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if x not in seen:
                seen.add(x)
                blobs.append(x)
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in find(t)])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(found, kind)], names=["blob", "found"])


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """New ledger rows ``(blob, version, found)`` for the blobs of ``docs`` that ``ledger`` lacks.

    A task first drops the repeats it holds, so a blob with any number of copies moves at most once
    from each task; the shuffle by blob then brings those together and one of them is scanned.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.cast("binary").alias("t"))
    if ledger is not None:
        done = ledger.where(F.col("version") == version).select("blob").distinct()
        unseen = checkpointed(docs.select(F.sha2(text, 256).alias("blob")).distinct().join(done, "blob", "left_anti"))
        blobs = blobs.join(F.broadcast(unseen) if unseen.count() <= SENT_BLOBS else unseen, "blob", "left_semi")
    first = blobs.mapInArrow(_first_seen, "blob string, t binary").repartition("blob")
    found = first.mapInArrow(_scan, "blob string, found array<struct<kind:string,start:long,end:long>>")
    return found.select("blob", F.lit(version).alias("version"), "found")


def findings(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(``id, blob, found`` per row of ``docs``, new ledger rows to append).

    ``found`` is sorted by start, then kind as in ``KINDS``; offsets are code points. Null counts as
    the empty text, which has no secrets. Repeated rows come back repeated. Rows without secrets come
    back with an empty array. Texts of any length are scanned whole.
    """
    new = scan_unseen(docs, ledger, text_col, version)
    known = new if ledger is None else new.unionByName(ledger.where(F.col("version") == version).select("blob", "version", "found"))
    return _joined(docs, known, id_col, text_col), new


def _joined(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs`` with what the ledger rows ``known`` have for its blob."""
    hit = known.where(F.size("found") > 0).select("blob", "found")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = paths(docs, id_col, text_col).join(hit, "blob", "left")
    return out.select("id", "blob", F.coalesce("found", empty).alias("found"))


LEDGER = "blob string, version string, found array<struct<kind:string,start:long,end:long>>"


def incremental(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """:func:`findings` by the ledger in ``folder``, to which what was scanned anew is appended first.

    A folder that doesn't exist is an empty ledger. Every blob of ``docs`` is in the ledger when findings are
    joined back, so the result is read from it alone; a run that is repeated scans nothing.
    """
    spark = docs.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan_unseen(docs, ledger, text_col, version).write.mode("append").parquet(folder)
    whole = spark.read.schema(LEDGER).parquet(folder)
    own = whole.where((F.col("version") == version) & (F.size("found") > 0)).dropDuplicates(["blob"])  # runs at the same time may scan the same
    own = own.repartition("blob", "version")  # so that both sides of the join are shuffled for it, and a blob of many copies can be split
    return _joined(docs, own, id_col, text_col)
