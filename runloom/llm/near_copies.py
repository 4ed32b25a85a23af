"""Near copies by SimHash candidates and exact Jaccard similarity of word shingles.

Fingerprints within ``max_bits`` bits, found by the pigeonring of ``simhash``, are candidates, but at a
similarity of 0.8 fingerprints of 64 bits differ in some ten bits, and chains that wide prune nothing. A
prefix filter finds the rest: if all shingle sets are put in one order, two sets with ``threshold`` in common
share a shingle among the first ``n - ceil(threshold * n) + 1`` of each. Any order gives the same pairs; rare
shingles first make few candidates. Every candidate is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm import simhash
from runloom.llm.common import checkpointed, connected_components, hashed_sample, releasing

#: Rows whose shingles tell which are common, and common ones that are put last. Both only bear on speed.
SAMPLE_ROWS, COMMON = 4_000, 100_000
#: Shingles seen so often in the sample are dealt to tasks by the text that holds them: to so many at least, and to one for
#: about so many texts.
OFTEN, SALTS, SALT_ROWS = 8, 64, 1 << 16
#: Nodes of a key that are paired at once; those of larger keys are held against one of them first.
DENSE = 32
#: Texts whose shingles a task holds at a time.
SLICE = 500
#: Pairs, about, of one task's comparison.
PAIRS = 500
#: Texts on each side of one comparison between parts, and shingles that are counted at a time.
TILE, COLUMNS = 256, 8192
#: Up to so many ids travel to the texts; beyond them the texts are shuffled to the ids.
SENT_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
    for i in range(k):
        out = (out + h[i : i + len(out)]) * _ODD
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def _least(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _named(shingle: int):
    """Id, node and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = b.column(1).to_pylist()
            both = np.array([[_node(_words(t)), simhash.fingerprint(t, shingle)] for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "node", "fp"])

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(_words(t), shingle).view(np.int64))], names=["x"])

    return run


def _prefixes(shingle: int, threshold: float, common: np.ndarray, times: np.ndarray, rows_each: float):
    """The prefix shingles of each different text of a task, with their places in it. A row of the sample stands for ``rows_each``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            parts = []
            for t in b.column(1).to_pylist():
                words = _words(t)
                node = _node(words)
                if node in seen:
                    continue
                seen.add(node)
                s = shingle_set(words, shingle)
                n, often = len(s), np.zeros(len(s), np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    often = np.where(common[at] == s, times[at], 0)
                    order = np.lexsort((s, often))
                    s, often = s[order], often[order]
                k = n - _least(n, threshold) + 1 if n else 0
                salts = np.maximum(SALTS, np.ceil(often[:k] * (rows_each / SALT_ROWS))).astype(np.uint64)
                salt = np.where(often[:k] >= OFTEN, 1 + (np.uint64(node) % salts).astype(np.int64), 0)
                parts.append((s[:k], salt, np.full(k, node, np.uint64), np.full(k, n), np.arange(k)))
            if parts:
                key, salt, node, n, i = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt, pa.int32()), pa.array(node.view(np.int64)), pa.array(n, pa.int32()), pa.array(i, pa.int32())], names=["key", "salt", "node", "n", "i"])

    return run


def _can_link(n, m, i, j, threshold: float):
    """Whether sets of n and m shingles that share the i-th and j-th, from 0, can be similar (of arrays)."""
    return np.minimum(i, j) + np.minimum(n - i, m - j) >= threshold / (1 + threshold) * (n + m) - 1e-9


def _may_link(threshold: float) -> Column:
    """:func:`_can_link` of columns."""
    return F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9


_MET = "key long, node long, n int, i int, other long, m int, j int"


def _meet(threshold: float, dense: int):
    """Rows sorted by key, salt and node to pairs (without a key), and to rows of dense or salted keys (without another node)."""

    def batch(k: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(k), pa.int64())
        cols = [k[:, 0] if other is None else none, *k.T[2:], *([none] * 3 if other is None else other.T[2:])]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _MET.split(", ")])

    def found(k: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(k), bool)
        new[1:] = (k[1:, :3] != k[:-1, :3]).any(axis=1)
        k = k[new]  # a text that several tasks have counts once
        first = np.ones(len(k), bool)
        first[1:] = (k[1:, :2] != k[:-1, :2]).any(axis=1)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(k)))
        wide = (size > dense) | (k[start, 1] > 0)
        for length in np.unique(size[~wide & (size > 1)]).tolist():
            a, b = np.triu_indices(length, 1)
            own = start[~wide & (size == length)]
            step = max(1, 50_000 // len(a))
            for at in range(0, len(own), step):
                u, v = k[(own[at : at + step, None] + a).ravel()], k[(own[at : at + step, None] + b).ravel()]
                ok = _can_link(u[:, 3], v[:, 3], u[:, 4], v[:, 4], threshold)
                yield batch(u[ok], v[ok])
        many = np.repeat(wide, size)
        if many.any():
            yield batch(k[many], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)
            other = np.flatnonzero((k[:, :2] != k[-1, :2]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and (held[-1][-1, :2] != k[0, :2]).any()):
                yield from found(np.concatenate([*held, k[:cut]]))
                held = []
            held.append(k[cut:])
        if held:
            yield from found(np.concatenate(held))

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and compressed words of each text."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        words = [_words(t) for t in b.column(1).to_pylist()]
        nodes = np.array([_node(w) for w in words], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([pack(b" ".join(w)) for w in words], pa.binary())], names=["node", "t"])


def _set_of(packed: bytes, shingle: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(bytes(packed)).split(), shingle)


def _similar(shingle: int, threshold: float):
    """The pairs of one bucket whose sets are similar."""

    def run(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        s = {node: _set_of(t, shingle) for node, t in zip(texts["node"], texts["t"])}
        ok = []
        for u, v in zip(pairs["u"], pairs["v"]):
            a, b = s[u], s[v]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = len(b) - 1
            both = int((b[at] == a).sum()) if len(a) else 0
            ok.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
        return pairs.loc[ok, ["u", "v"]]

    return run


def _sent(texts: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """``needed`` with the text ``t`` of each row's ``node``; only texts that are needed are moved."""
    asked = checkpointed(nodes.join(needed.select("node").distinct(), "node").select("id").distinct())
    few = asked.count() <= SENT_IDS
    mine = texts.join(F.broadcast(asked) if few else asked, "id", "left_semi").select("id", "t").mapInArrow(releasing(_texts), "node long, t binary")
    return needed.join(mine, "node")


def dealt(pairs: DataFrame, n: int) -> DataFrame:
    """``n`` ``pairs`` (u, v) with the ``bucket`` in which each is compared.

    Pairs are dealt into buckets by the first node that their second one meets, so that a group's texts go to one
    bucket, by the second one itself where that makes more than ``PAIRS``, and by both where the second one has more
    than ``PAIRS`` alone.
    """
    label = checkpointed(pairs.groupBy("v").agg(F.min("u").alias("label"), F.count("*").alias("c")))
    parts = label.groupBy("label").agg(F.ceil(F.sum("c") / PAIRS).alias("parts"))
    salt = F.when(F.col("c") > PAIRS, F.pmod(F.xxhash64("u"), F.ceil(F.col("c") / PAIRS))).otherwise(0)
    bucket = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("v"), F.col("parts")), salt), F.lit(math.ceil(n / PAIRS)))
    return checkpointed(pairs.join(label.join(parts, "label"), "v").select("u", "v", bucket.alias("bucket")))


def _links(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of the candidate ``pairs`` that are similar. A text goes once to each bucket of :func:`dealt` that needs it."""
    pairs = checkpointed(pairs.distinct())
    n = pairs.count()
    if not n:
        return pairs
    placed = dealt(pairs, n)
    needed = checkpointed(placed.select(F.col("u").alias("node"), F.col("bucket").alias("at")).unionByName(placed.select(F.col("v").alias("node"), F.col("bucket").alias("at"))).distinct())
    sent = _sent(texts, nodes, needed).groupBy("at")
    return checkpointed(placed.groupBy("bucket").cogroup(sent).applyInPandas(_similar(shingle, threshold), "u long, v long"))


def _tile(shingle: int, threshold: float):
    """Links between different parts in one tile pair, of its rows of ``side`` 0 with those of side 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["side", "node"])
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        x, y = ([_set_of(t, shingle) for t in side["t"]] for side in (a, b))
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        both = np.zeros((len(x), len(y)), np.float32)
        known = np.intersect1d(np.concatenate(x), np.concatenate(y))
        for at in range(0, len(known), COLUMNS):
            own = known[at : at + COLUMNS]
            has = []
            for side in (x, y):
                m = np.zeros((len(side), len(own)), np.float32)
                for i, s in enumerate(side):
                    m[i, np.searchsorted(own, s[np.isin(s, own, assume_unique=True)])] = 1
                has.append(m)
            both += has[0] @ has[1].T
        sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        i, j = np.nonzero((both >= threshold * (sizes - both) - 1e-6) & (a["part"].to_numpy()[:, None] != b["part"].to_numpy()[None, :]))
        return pd.DataFrame({"u": a["node"].to_numpy()[i], "v": b["node"].to_numpy()[j]})

    return run


def _across(hot: DataFrame, lead: DataFrame, comp: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links between the parts that nodes of dense keys are in, of those that were held against the same node.

    What shares a key of no dense run has been decided. So a text has at most its ``w`` dense keys and the
    ``threshold * n`` shingles behind its prefix in common with one of another part, and of two with few dense
    keys ("weak") none can be similar. Nodes outside the common node's part ("outer") are compared with all others,
    weak ones with strong ones only, in tiles, whose number grows with both; no pair is written down that
    doesn't link.
    """
    part = F.coalesce("component", "node")
    weak = F.col("w") <= threshold * (1 - threshold) / (1 + threshold) * F.col("n") + 1e-9
    members = hot.join(lead.select("key", F.col("other").alias("lead")), "key").groupBy("lead", "node").agg(F.any_value(weak).alias("weak"))
    members = members.join(comp, "node", "left").select("lead", "node", part.alias("part"), "weak")
    main = members.where("node = lead").select("lead", F.col("part").alias("main"))
    members = checkpointed(members.join(main, "lead").withColumn("outer", F.col("part") != F.col("main")))
    at = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles))
    every = lambda tiles: F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1))
    keep = ["lead", "family", "node", "part"]
    needed = None
    for family, (own, others) in enumerate((("outer AND NOT weak", "true"), ("outer AND weak", "NOT weak"))):
        size = members.groupBy("lead").agg(F.ceil(F.count_if(F.expr(own)) / TILE).alias("ta"), F.ceil(F.count_if(F.expr(others)) / TILE).alias("tb")).where("ta > 0 AND tb > 0")
        rows = members.join(size, "lead").withColumn("family", F.lit(family))
        looked_up = rows.where(own).select(*keep, at("ta").alias("a"), every("tb").alias("b"), F.lit(0).alias("side"))
        among = rows.where(others).select(*keep, every("ta").alias("a"), at("tb").alias("b"), F.lit(1).alias("side"))
        both = looked_up.unionByName(among)
        needed = both if needed is None else needed.unionByName(both)
    needed = checkpointed(needed)
    if needed.isEmpty():
        return needed.select(F.col("node").alias("u"), F.col("node").alias("v"))
    return checkpointed(_sent(texts, nodes, needed).groupBy("lead", "family", "a", "b").applyInPandas(_tile(shingle, threshold), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """``(id, component)`` per row: the smallest id reachable by links of similar texts.

    Two texts link if the Jaccard similarity of their sets of ``shingle`` words is at least ``threshold``,
    or if their words are equal (A-Z lower-cased, split at ASCII white space; so do texts without a word).
    Rows of one id are one. Rows without an id have the component of the rows with equal words, null if
    there is none.

    Equal texts are one node before any candidate is made. Prefix shingles are shuffled once, as numbers;
    texts are read again instead of being moved with them. Nodes that share a prefix shingle are paired, and
    a pair is verified unless the prefix shingles that it shares, and all that may follow the last of them, are
    too few. Where more than ``dense`` share a shingle, each is first held against that of them which shares
    most of its shingles so, and then only against those that are not in its component yet. Shingles that are
    frequent in a sample are dealt to several tasks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    total = texts.count()
    seen = hashed_sample(texts, ["id", "t"], SAMPLE_ROWS, total).mapInArrow(releasing(_shingles(shingle)), "x long")
    often = seen.groupBy("x").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "x").limit(COMMON).collect()
    common, times = np.array([r.x for r in often], np.int64).view(np.uint64), np.array([r.n for r in often], np.int64)
    order = np.argsort(common)
    rows = checkpointed(texts.mapInArrow(releasing(_named(shingle)), "id long, node long, fp long"))
    known = rows.where("id IS NOT NULL")
    nodes = checkpointed(known.groupBy("node").agg(F.min("id").alias("id"), F.any_value("fp").alias("fp")))

    by_print = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    alike = nodes.join(by_print, "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    close = simhash.links(by_print.select(F.col("rep").alias("node"), "fp"), max_bits)
    keyed = texts.where("id IS NOT NULL").mapInArrow(releasing(_prefixes(shingle, threshold, common[order], times[order], max(1.0, total / SAMPLE_ROWS))), "key long, salt int, node long, n int, i int")
    met = keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(releasing(_meet(threshold, dense)), _MET)
    met = checkpointed(met)
    hot = met.where("key IS NOT NULL").select("key", "node", "n", "i")
    wide = checkpointed(hot.groupBy("node").agg(F.count("*").alias("w")))
    hot = checkpointed(hot.join(wide, "node"))
    pairs = met.where("key IS NULL").groupBy(F.col("node").alias("u"), F.col("other").alias("v")).agg(F.count("*").alias("both"), F.max("n").alias("n"), F.max("i").alias("i"), F.max("m").alias("m"), F.max("j").alias("j"))
    for node in ("u", "v"):
        pairs = pairs.join(wide.select(F.col("node").alias(node), F.col("w").alias(f"w{node}")), node, "left")
    most = F.col("both") + F.least(F.coalesce("wu", F.lit(0)), F.coalesce("wv", F.lit(0))) + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    pairs = pairs.where(most >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9)
    share = (F.col("w") / F.col("n")).alias("share")  # nearly all of what a group's origin has is shared
    lead = hot.groupBy("key").agg(F.max(F.struct(share, "node", "n", "i")).alias("c")).select("key", F.col("c.node").alias("other"), F.col("c.n").alias("m"), F.col("c.i").alias("j"))
    lead = checkpointed(lead)
    stars = hot.join(lead, "key").where("node <> other").where(_may_link(threshold)).select(F.col("node").alias("u"), F.col("other").alias("v"))
    found = pairs.select("u", "v").unionByName(stars).unionByName(alike).unionByName(close)
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    repeated = known.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("id", "u")
    one = known.join(repeated, "id").select("u", F.col("node").alias("v")).distinct()
    edges = _links(found, texts, nodes, shingle, threshold).unionByName(one)
    comp = checkpointed(connected_components(edges))

    late = _across(hot, lead, comp, texts, nodes, shingle, threshold)
    if late.head(1):
        roots = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
        comp = checkpointed(connected_components(roots.unionByName(late)))

    named = nodes.select("node", "id").join(comp, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy("part").agg(F.min("id").alias("component"))
    named = named.select("node", "part").join(least, "part").select("node", "component")
    return rows.select("id", "node").join(named, "node", "left").select("id", "component")
