"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, with only the columns that are asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on one machine (a local master) may it be unset, and a
    temporary folder is taken."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[[^-]*)?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving what its task freed back to the machine when it ends: a worker that is used again else keeps the
    memory of the largest task that it ever ran beside what its next one takes."""

    @functools.wraps(run)
    def freeing(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return freeing


def hashed_sample(df: DataFrame, columns: list[str], rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``: those whose hash over ``columns`` falls below that share of all values.

    The same rows in any order and partitioning; nothing is sorted or moved. ``total`` is the number of
    rows, counted if it isn't given.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    return df.where(F.xxhash64(*columns) < -(1 << 63) + (1 << 64) * rows // total)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has long columns ``u`` and ``v``; direction, repeats and self-loops don't matter. The
    result has one row ``(node, component)`` per node of an edge. Alternating large-star and
    small-star rounds: each is one partially aggregated minimum per node and one equi-join. The minima are
    shuffled on their own before the join, so that both of its sides are shuffles and skew-join handling
    can split a hub's edges. Rounds end when the edge set stops changing; its size and an order-free hash
    are all that reach the driver.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    e = e.where("u IS NOT NULL AND v IS NOT NULL")
    nodes_alone = e.where("u = v").select("u")
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(e)
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition("u", "m")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u", "m")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = checkpointed(e)
        state = _state(e)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes_alone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
