"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are 64 majority bits over the XXH64 values of a text's word shingles. Two fingerprints
link when they differ in at most ``max_bits`` bits. Candidates come from a ring of segments: by the
pigeonring principle, if a whole ring of m segments differs in at most t bits, there is a segment from
which *every* chain of l consecutive segments differs in at most floor(l * t / m) bits. With t = 2 and
m = 5 the budgets are 0, 0, 1, 1, 2: the first two segments of that chain agree exactly, so those 26
bits are the key of an equi-join, and the longer chains prune what meets there before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed, connected_components

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``; 0 if it has no word.

    A-Z are lower-cased, words are split at ASCII white space, shingles count with repeats and a text
    of fewer words is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8).astype(np.int64)
        if len(part) < 64:
            ones += _BYTE_BITS[part].sum(axis=0).reshape(-1)
        else:
            counts = np.bincount((part + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
            ones += (counts @ _BYTE_BITS).reshape(-1)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row ``(id, fp)`` per row of ``docs``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def ring(max_bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, highest bits first."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(BITS - sum(widths[: i + 1]), w) for i, w in enumerate(widths)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def chain_ok(a: Column, b: Column, start: int, max_bits: int, segments: int) -> Column:
    """Whether every chain from segment ``start`` keeps within its proportional budget."""
    parts = ring(max_bits, segments)
    ok, total = F.lit(True), F.lit(0)
    for length in range(1, segments + 1):
        shift, width = parts[(start + length - 1) % segments]
        total = total + F.bit_count(_segment(a.bitwiseXOR(b), shift, width))
        ok = ok & (total <= length * max_bits // segments)
    return ok


def links(fps: DataFrame, max_bits: int = 2, segments: int = 5, dense: int = 64) -> DataFrame:
    """Edges ``(u, v)`` whose components equal those of all pairs within ``max_bits`` bits.

    ``fps`` has distinct ``fp`` with a ``node`` each. Chain keys shared by up to ``dense`` fingerprints
    are joined pairwise and filtered by the chain budgets. Denser keys would make quadratically many
    pairs; their fingerprints meet at shared single-bit neighbours instead, which is exact for
    ``max_bits`` of 2 (two values differ in at most 2 bits if and only if they share a value within 1
    bit of both) and makes 65 rows a fingerprint however many share a key.
    """
    if max_bits != 2:
        raise ValueError("the dense path is exact for max_bits = 2 only")
    parts = ring(max_bits, segments)
    exact = next(n for n in range(1, segments + 1) if (n + 1) * max_bits // segments > 0)
    keys = []
    for i in range(segments):
        key = F.lit(0).cast("long")
        for j in range(exact):
            shift, width = parts[(i + j) % segments]
            key = F.shiftleft(key, width).bitwiseOR(_segment(F.col("fp"), shift, width))
        keys.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
    keyed = fps.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", "k.i", "k.key")
    shared = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpointed(keyed.join(shared, ["i", "key"]))
    sparse = met.where(F.col("n") <= dense)
    a = sparse.select("i", "key", F.col("node").alias("u"), F.col("fp").alias("a"))
    b = sparse.select("i", "key", F.col("node").alias("v"), F.col("fp").alias("b"))
    by_start = F.lit(False)
    for i in range(segments):
        by_start = by_start | ((F.col("i") == i) & chain_ok(F.col("a"), F.col("b"), i, max_bits, segments))
    full = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = a.join(b, ["i", "key"]).where(F.col("u") < F.col("v")).where(by_start & full).select("u", "v")
    hot = met.where(F.col("n") > dense).select("node", "fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(s).cast("long")) for s in _single_bits()])
    stars = hot.select("node", F.explode(near).alias("x"))
    centre = stars.groupBy("x").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("x", "v")
    met_at = stars.join(centre, "x").select(F.col("node").alias("u"), "v").where("u <> v")
    return pairs.unionByName(met_at)


def _single_bits() -> list[int]:
    return [(1 << i) if i < 63 else -(1 << 63) for i in range(BITS)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, segments: int = 5, dense: int = 64) -> DataFrame:
    """``(id, fp, component)`` per row: the smallest id reachable by links of at most ``max_bits`` bits.

    Null, empty and white-space texts have fingerprint 0 and link like any other. Equal fingerprints
    are one node, named by their smallest id, before any candidate is made, so exact copies cost one
    row. Rows without an id have no component of their own: they get the smallest id of the rows they
    link with through their fingerprint, null if there is none. Repeated rows come back repeated, an
    empty table gives an empty result, and further columns of ``docs`` are never looked at.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node"))
    nodes = checkpointed(nodes)
    comp = connected_components(links(nodes, max_bits, segments, dense))
    named = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(named, "fp", "left").select("id", "fp", "component")
