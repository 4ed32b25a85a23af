"""Embedding near-duplicates by sorted projection passes.

Every pass hashes a vector to the signs of ``BITS`` random projections, orders all vectors
lexicographically by these concatenated bits and compares each with the ``window`` that follow it. Links
found in any pass are joined to components; inside a component all links are then counted exactly.

Windows alone would miss links where vectors lie dense. A pair at the threshold's angle agrees on a bit with
probability ``1 - angle / pi``; a pass finds it for sure if it agrees on as many leading bits as tell a vector
from all but the ``window`` around it. That number is measured for each vector in each pass, so the chance
that any of its links is still missed is known: passes go on, over the vectors for which that chance exceeds
``miss``, until there are none, or until so few are left that they are compared with each other in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed, connected_components

#: Projections of a pass, neighbours compared on each side, and rows that a task compares at a time.
BITS, WINDOW, BLOCK = 62, 1024, 8192
#: Rounds after which vectors that are still too dense are compared in tiles.
ROUNDS = 4
#: Chance at which a link at the threshold may be missed.
MISS = 0.01
#: Vectors on each side of one exact comparison.
TILE = 2048


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def agreement(threshold: float) -> float:
    """Chance that two vectors at the threshold's angle fall on one side of a random plane."""
    return 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi


def passes_for(n: int, window: int, threshold: float, miss: float = MISS) -> int:
    """Passes after which a link is missed with a chance of ``miss`` among ``n`` vectors that lie evenly."""
    bits = math.ceil(math.log2(max(1.0, n / window)))
    found = agreement(threshold) ** bits
    return 1 if found >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - found))


def _keys(passes: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            nodes, dims, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.concatenate([np.random.default_rng([seed, d, p]).standard_normal((d, BITS)) for p in passes], axis=1)
                x = _unit([np.array(vectors[i]) for i in at])
                signs = (x @ planes[d] > 0).reshape(len(at), len(passes), BITS)
                key = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                n = len(at) * len(passes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[at], len(passes))), pa.array(np.full(n, d), pa.int32()), pa.array(np.tile(passes, len(at)), pa.int32()), pa.array(key.ravel(), pa.int64())],
                    names=["node", "dim", "pass", "key"],
                )

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches by the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits of ``BITS`` that two keys have in common."""
    x = (a ^ b).astype(np.float64)  # rounding up to a power of two only makes the count smaller by one
    return np.where(x == 0, BITS, BITS - np.frexp(np.maximum(x, 1))[1])


#: Largest error of a cosine of unit vectors in half precision: each product is off by 2 ** -10 of itself, some more for tiny components.
HALF_ERROR = 0.0012


def _halves(pdf_v) -> np.ndarray:
    return np.stack([np.frombuffer(bytes(v), "<f2") for v in pdf_v]).astype(np.float32)


def _compare(threshold: float, window: int, block: int, shallow: int):
    """Links of one block: edges that connect what its windows connect, pairs too near the threshold to tell in
    half precision (``sure`` false), and (with a null v) leading bits beyond ``shallow`` that a window needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        node, key = pdf["node"].to_numpy(), pdf["key"].to_numpy()
        own_rows = pdf["place"].to_numpy() // block == pdf["block"].to_numpy()
        out = []
        for (_, p), own in pdf.groupby(["dim", "pass"], sort=False).indices.items():
            x = _halves(pdf["v"].iloc[own])
            sure, maybe = [], []
            for at in range(0, len(x), 512):
                s = x[at : at + 512] @ x[at : at + 512 + window].T
                i, j = np.nonzero(s >= threshold - HALF_ERROR)
                ok = (j > i) & (j - i <= window)
                i, j = i[ok], j[ok]
                known = s[i, j] >= threshold + HALF_ERROR
                sure.append((i[known] + at, j[known] + at))
                maybe.append((i[~known] + at, j[~known] + at))
            label = _forest(len(x), np.concatenate([f[0] for f in sure]), np.concatenate([f[1] for f in sure]))
            linked = np.flatnonzero(label != np.arange(len(x)))
            out.append((node[own][linked], node[own][label[linked]], np.ones(len(linked), bool), np.zeros(len(linked), int), np.full(len(linked), p)))
            i, j = (np.concatenate([f[k] for f in maybe]) for k in (0, 1))
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            out.append((node[own][i], node[own][j], np.zeros(len(i), bool), np.zeros(len(i), int), np.full(len(i), p)))
            if len(x) > window:
                k = key[own]
                bits = _common_bits(k[:-window], k[window:]) + 1
                deep = np.flatnonzero(bits > shallow)
                ahead = deep[own_rows[own][deep]]
                for rows, n in ((ahead, bits[ahead]), (deep + window, bits[deep])):
                    out.append((node[own][rows], np.full(len(rows), -1), np.zeros(len(rows), bool), n, np.full(len(rows), p)))
        u, v, sure, bits, p = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"u": u, "v": v, "sure": sure, "bits": bits.astype(np.int32), "pass": p.astype(np.int32)})

    return run


def _passes(nodes: DataFrame, n: int, passes: list[int], threshold: float, window: int, block: int, seed: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes whose links may be missed with more than a chance of ``miss``) of some passes over ``n`` nodes.

    ``missed`` of a node is the logarithm of that chance, after the rounds so far; the nodes come back with theirs.
    """
    shallow = math.ceil(math.log2(max(1.0, n / window)))
    keyed = nodes.select("node", F.size("v").alias("dim"), "v").mapInArrow(_keys(passes, seed), "node long, dim int, pass int, key long")
    order = ["pass", "dim", "key", "node"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.monotonically_increasing_id().alias("m"))
    placed = checkpointed(placed)
    part = F.shiftright("m", 33)
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r.p, before))
        before += r.n
    start = placed.sparkSession.createDataFrame(offsets, "p long, start long")
    place = F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("p", part).join(F.broadcast(start), "p").select(*order, place.alias("place"))  # a row per partition
    own = F.floor(F.col("place") / block)
    blocks = F.when((F.col("place") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    small = nodes.select("node", F.size("v").alias("dim"), "v").mapInArrow(_half, "node long, h binary").withColumnRenamed("h", "v")
    dealt = ranked.select(*order, "place", F.explode(blocks).alias("block")).join(small, "node")
    found = checkpointed(dealt.groupBy("block").applyInPandas(_compare(threshold, window, block, shallow), "u long, v long, sure boolean, bits int, pass int"))
    edges = found.where("sure").select("u", "v")
    maybe = found.where("NOT sure AND v >= 0 AND bits = 0").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = edges.unionByName(_exactly(maybe, nodes, threshold))
    log_missed = lambda bits: F.log1p(-F.pow(F.lit(agreement(threshold)), bits))
    rest = float(math.log1p(-(agreement(threshold) ** shallow))) if shallow else -math.inf
    if not shallow:
        return edges, nodes.limit(0).select("node", "missed")
    deep = found.where("v = -1 AND bits > 0").groupBy("u", "pass").agg(F.max("bits").alias("bits")).groupBy("u").agg((F.sum(log_missed(F.col("bits"))) + (len(passes) - F.count("*")) * rest).alias("missed"))
    deep = deep.select(F.col("u").alias("node"), F.col("missed").alias("now")).join(nodes.select("node", "missed"), "node").select("node", (F.col("now") + F.col("missed")).alias("missed"))
    return edges, deep.where(F.col("missed") > math.log(miss))


def _half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in half precision."""
    for b in batches:
        rows = [_unit([np.array(v)])[0].astype("<f2").tobytes() for v in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["node", "h"])


def _exactly(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose cosine in double precision is at least ``threshold``."""
    a, b = (nodes.select(F.col("node").alias(n), F.col("v").alias(x)) for n, x in (("u", "a"), ("v", "b")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    largest = lambda c: F.array_max(F.transform(c, F.abs))
    scaled = lambda c: F.transform(c, lambda x: x / largest(c))
    rows = pairs.join(a, "u").join(b, "v").select("u", "v", scaled(F.col("a")).alias("a"), scaled(F.col("b")).alias("b"))
    dot = add(F.zip_with("a", "b", lambda x, y: x * y))
    norm = lambda c: F.sqrt(add(F.transform(c, lambda x: x * x)))
    return rows.where(dot / norm("a") / norm("b") >= threshold).select("u", "v")


def _all_pairs(threshold: float):
    """Edges that connect what the exact cosines of one tile pair connect."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        i, j = np.nonzero(_unit(a["v"].tolist()) @ _unit(b["v"].tolist()).T >= threshold)
        label = _forest(len(a) + len(b), i, j + len(a))
        both = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
        linked = np.flatnonzero(label != np.arange(len(both)))
        return pd.DataFrame({"u": both[linked], "v": both[label[linked]]})

    return run


def _tiles(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Edges among ``n`` nodes by comparing all of them, tile by tile; no pair is written down that doesn't link."""
    tiles = -(-n // TILE)
    own = F.pmod(F.xxhash64("node"), F.lit(tiles))
    up, down = F.explode(F.sequence(own, F.lit(tiles - 1).cast("long"))), F.explode(F.sequence(F.lit(0).cast("long"), own))
    rows = nodes.select("node", "v", F.size("v").alias("dim"))
    dealt = rows.select("node", "v", "dim", own.alias("a"), up.alias("b"), F.lit(0).alias("side")).unionByName(rows.select("node", "v", "dim", down.alias("a"), own.alias("b"), F.lit(1).alias("side")))
    return dealt.groupBy("dim", "a", "b").applyInPandas(_all_pairs(threshold), "u long, v long")


def _tile(threshold: float):
    """Copies linked to each vector of one tile pair (``side`` 0: looked up, ``side`` 1: looked among)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = pd.DataFrame({"node": a["node"], "far": 0}).astype("int64")
        if len(a) and len(b):
            s = _unit(a["v"].tolist()) @ _unit(b["v"].tolist()).T >= threshold
            s &= a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :]
            out["far"] = s @ b["copies"].to_numpy()
            back = pd.DataFrame({"node": b["node"], "far": (s & ~b["outer"].to_numpy()[None, :]).T @ a["copies"].to_numpy()})
            out = pd.concat([out, back[back["far"] > 0]])
        return out.astype("int64")

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, window: int = WINDOW, block: int = BLOCK, miss: float = MISS, seed: int = 7) -> DataFrame:
    """Per row of ``vectors``: ``id, n_links, component, kept``.

    A link is a cosine of at least ``threshold`` in double precision; ``n_links`` counts the other rows
    linked with this one, copies included, ``component`` is the smallest id reachable and ``kept``
    whether that is its own. Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of different lengths, link with nothing; neither do rows without an id, which have no
    component and aren't kept. Repeated rows come back repeated, each counting the others.

    Equal vectors are one node. Only (pass, key, node) rows are sorted: a range partitioning that splits
    no further than it must, then ranks from each partition's row count. A block is ``block`` ranks and
    the ``window`` that follow, so tasks are of one size whatever keys are frequent, and no neighbour is
    missed where partitions or blocks meet. Vectors travel to the blocks in half precision; what that
    can't tell is decided in double precision. The number of passes follows the number of vectors and
    ``miss``, and how dense they lie (see the module). In a component whose members all lie within half the
    threshold's angle of its mean direction ("inner"), every pair links, and counting needs no
    comparison; other members ("outer") are compared with the whole component in tiles of ``TILE``.
    """
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = rows.where(good & F.col("id").isNotNull())
    nodes = checkpointed(usable.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies")))

    active, n, first, edges = nodes.withColumn("missed", F.lit(0.0)), nodes.count(), 0, None
    for _ in range(ROUNDS):
        many = passes_for(n, window, threshold, miss)
        found, dense = _passes(active, n, list(range(first, first + many)), threshold, window, block, seed, miss)
        edges = found if edges is None else edges.unionByName(found)
        first += many
        active = checkpointed(active.drop("missed").join(dense, "node"))
        n = active.count()
        if n <= TILE * 4:
            break
    if n:
        edges = edges.unionByName(_tiles(active, n, threshold))
    comp = checkpointed(connected_components(edges))

    counted = _count(nodes.join(comp, "node"), threshold)
    named = nodes.join(comp, "node", "left").join(counted, "node", "left")
    named = named.select("v", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = usable.join(named, "v").select("id", "n_links", "component", (F.col("id") == F.col("component")).alias("kept"))
    alone = rows.where(~F.coalesce(good, F.lit(False)) | F.col("id").isNull())
    return linked.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.col("id").isNotNull().alias("kept")))


def _count(members: DataFrame, threshold: float) -> DataFrame:
    """``(node, others)``: rows of other vectors that link with the node inside its component.

    All vectors of a component have one length; its mean direction is summed up place by place.
    """
    half = np.arccos(threshold) / 2 - 1e-6
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = checkpointed(members.withColumn("unit", F.transform("v", lambda x: x / norm)))
    places = own.select("component", F.posexplode("unit").alias("i", "x")).groupBy("component", "i").agg(F.avg("x").alias("x"))
    mean = places.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("mean"))
    mean = mean.repartition("component", "mean")  # so that the join can split a large component
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    cosine = F.aggregate(F.zip_with("unit", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / length
    own = own.join(mean, "component").withColumn("outer", ~F.coalesce(cosine >= float(np.cos(half)), F.lit(False))).select("component", "node", "copies", "v", "outer")
    own = checkpointed(own)
    size = own.groupBy("component").agg(
        F.sum(F.when(F.col("outer"), 0).otherwise(F.col("copies"))).alias("inner_copies"), F.count("*").alias("n"), F.count_if("outer").alias("n_outer")
    )
    own = own.join(size.repartition("component", "n"), "component")
    near = own.where("NOT outer").select("node", (F.col("inner_copies") - F.col("copies")).alias("others"))
    mixed = own.where("n_outer > 0").withColumn("ta", F.ceil(F.col("n_outer") / TILE)).withColumn("tb", F.ceil(F.col("n") / TILE))
    at = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles))
    every = lambda tiles: F.explode(F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1))
    columns = ["component", "node", "copies", "v", "outer"]
    looked_up = mixed.where("outer").select(*columns, at("ta").alias("a"), every("tb").alias("b"), F.lit(0).alias("side"))
    among = mixed.select(*columns, every("ta").alias("a"), at("tb").alias("b"), F.lit(1).alias("side"))
    far = looked_up.unionByName(among).groupBy("component", "a", "b").applyInPandas(_tile(threshold), "node long, far long")
    return near.unionByName(far.select("node", F.col("far").alias("others"))).groupBy("node").agg(F.sum("others").alias("others"))
