"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are cut into windows of ``window`` consecutive normalised words (an item of fewer is one
window). All windows go into one automaton; every document is normalised and scanned once, and each
hit is mapped back to words and, on demand, to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed

#: A-Z become a-z, digits, a-z and all bytes of non-ASCII characters stay, the rest is white space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Largest benchmark text, in bytes, that one automaton is built from (about 60 times as much memory).
MAX_AUTOMATON_BYTES = 8 << 20


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of UTF-8 ``text``."""
    return (text or b"").translate(_NORMAL).split()


def windows(text: bytes | None, window: int = 10) -> set[bytes]:
    """The distinct windows of an item, space-joined."""
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


def build(items: list[tuple[str, bytes | None]], window: int = 10):
    """(automaton, item ids by window, words by window); the automaton is None if no item has a word."""
    owners: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for w in windows(text, window):
            owners.setdefault(w, []).append(k)
    if not owners:
        return None, [], []
    auto = ahocorasick.Automaton()
    by_window, sizes = [], []
    for n, (w, who) in enumerate(owners.items()):
        auto.add_word(f" {w.decode('latin-1')} ", n)
        by_window.append(who)
        sizes.append(w.count(b" ") + 1)
    auto.make_automaton()
    return auto, by_window, sizes


def scan(auto, by_window: list[list[int]], sizes: list[int], text: bytes | None):
    """(words, hit ranges of words, items) of one text; ranges are sorted, disjoint, end-exclusive."""
    w = words(text)
    if auto is None or not w:
        return len(w), [], set()
    flat = f" {b' '.join(w).decode('latin-1')} "
    found = list(auto.iter(flat))
    if not found:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found])  # the space after word k is number k + 1
    who = {k for n in {n for _, n in found} for k in by_window[n]}
    return len(w), merged((int(end) - sizes[n], int(end)) for end, (_, n) in zip(last, found)), who


def merged(ranges) -> list[tuple[int, int]]:
    """The union of end-exclusive ranges, sorted and disjoint."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as (start, end) code points of the original text."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    return [(len(raw[: places[a][0]].decode()), len(raw[: places[b - 1][1]].decode())) for a, b in ranges]


_built: dict = {}


def _automaton(key, items, window):
    if key not in _built:
        _built.clear()
        _built[key] = build(items, window)
    return _built[key]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Per row of ``docs``: ``id, n_words, n_hit, items array<string>, spans array<struct<start,end>>``.

    ``spans`` are code points of the original text, ``items`` the ids of items with a window in it,
    sorted as strings. A word counts once however many windows cover it. Null texts have no words;
    null items and items without words match nothing; items without an id count for hits but are not
    listed; repeated items are listed once; empty tables are allowed on either side.

    The benchmark goes to the tasks inside the function's closure after its size has been summed: up to
    ``max_bytes`` in one automaton. A larger one is dealt into that many parts and the documents pass
    the parts one after the other, each pass adding to the ranges found so far.
    """
    item = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").cast("binary").alias("t")).where("t IS NOT NULL")
    total = item.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:long,b:long>>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    kind = dict(rows.dtypes)["id"]
    between = f"id {kind}, t binary, n_words long, ranges array<struct<a:long,b:long>>, items array<string>"
    result = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    for part in range(parts):
        mine = [(r.i, bytes(r.t)) for r in item.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).collect()]
        last = part == parts - 1
        rows = rows.mapInArrow(_scanner(mine, window, last), result if last else between)
        if not last:
            rows = checkpointed(rows)
    return rows


def _scanner(items: list[tuple[str, bytes]], window: int, last: bool):
    key = (window, hashlib.sha256(repr(items).encode()).hexdigest())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, by_window, sizes = _automaton(key, items, window)
        ids = [i for i, _ in items]
        for b in batches:
            texts = b.column(1).to_pylist()
            n, ranges, names = [], [], []
            for t, had, listed in zip(texts, b.column(3).to_pylist(), b.column(4).to_pylist()):
                count, got, who = scan(auto, by_window, sizes, t)
                n.append(count)
                ranges.append(merged([*((r["a"], r["b"]) for r in had), *got]) if had else got)
                names.append(sorted({*listed, *(ids[k] for k in who if ids[k] is not None)}))
            listed_by = pa.array(names, pa.list_(pa.string()))
            if last:
                hit = pa.array([sum(y - x for x, y in r) for r in ranges], pa.int64())
                at = [[{"start": x, "end": y} for x, y in original_spans(t.decode(), r)] if r else [] for t, r in zip(texts, ranges)]
                cols = [b.column(0), pa.array(n, pa.int64()), hit, listed_by, pa.array(at, span)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_hit", "items", "spans"])
            else:
                kept = pa.array([[{"a": x, "b": y} for x, y in r] for r in ranges], pair)
                cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), kept, listed_by]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "t", "n_words", "ranges", "items"])

    return run
