"""Directories listed by tasks: entries of every kind, with what couldn't be read as rows, and hashed files."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import stat
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.sources.shared import shared_folder

#: Bytes that a file is hashed by.
HASH_BLOCK = 1 << 20
ENTRY = "path string, kind string, size_bytes long, mtime timestamp, links long, error string"
_MADE = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("links", pa.int64()), ("error", pa.string())])

#: Codes of what can't be verified, by the kind of the entry.
UNVERIFIED_KINDS = {"error": "directory-io-unverified", "link": "directory-symlink-unverified", "other": "directory-special-file-unverified"}


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(quote(re.sub("^file:/+|^/+", "file:///", uri, count=1), safe=":/@[]"))


def _local(place: str, path: str) -> Iterator[dict]:
    below = lambda name: f"{path}/{name}" if path else name
    with os.scandir(place) as entries:
        for e in entries:
            try:
                info = e.stat(follow_symlinks=False)
            except OSError as err:
                yield {"path": below(e.name), "kind": "error", "error": type(err).__name__}
                continue
            mode = info.st_mode
            kind = "link" if stat.S_ISLNK(mode) else "directory" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"
            plain = kind == "file"
            yield {"path": below(e.name), "kind": kind, "size_bytes": info.st_size if plain else None, "mtime": datetime.fromtimestamp(info.st_mtime, timezone.utc), "links": info.st_nlink if plain else None}


def _stored(store: pafs.FileSystem, place: str, path: str) -> Iterator[dict]:
    for e in store.get_file_info(pafs.FileSelector(place)):
        kind = {pafs.FileType.File: "file", pafs.FileType.Directory: "directory"}.get(e.type, "other")
        yield {"path": f"{path}/{e.base_name}" if path else e.base_name, "kind": kind, "size_bytes": e.size if kind == "file" else None, "mtime": e.mtime}


def entries_of(root: str, path: str) -> Iterator[dict]:
    """Entries of one directory; one row of kind ``error`` for the directory if it can't be read. Links aren't followed."""
    try:
        store, at = open_store(root)
        place = f"{at.rstrip('/')}/{path}" if path else at
        yield from _local(place, path) if isinstance(store, pafs.LocalFileSystem) else _stored(store, place, path)
    except (OSError, pa.ArrowException, ValueError) as e:
        yield {"path": path, "kind": "error", "error": type(e).__name__}


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, (root, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            for rows in itertools.batched(entries_of(root, path), 10_000):
                found = pa.RecordBatch.from_pylist([dict.fromkeys(_MADE.names) | r for r in rows], _MADE)
                repeated = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(repeated), b.column(1).take(repeated), *found.columns], names=["dir_id", "root", *_MADE.names])


def list_directories(roots: DataFrame) -> DataFrame:
    """``dir_id, root, path, kind, size_bytes, mtime, links, error`` of everything below the ``root`` of each ``dir_id``.

    ``kind`` is file, directory, link, other or error; paths are relative to the root, the root itself has no row but an
    error (path empty) if it can't be read. No content is read and no link followed. All roots are listed together, a
    round for each depth: tasks list the directories that the round before found, and what they find is appended to
    a table in the shared folder. A root of no directory at all gives nothing; a null root is an error row.
    """
    spark = roots.sparkSession
    to = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    kind = dict(roots.dtypes)["dir_id"]
    front = roots.select("dir_id", F.coalesce("root", F.lit("")).alias("root"), F.lit("").alias("path"))
    for depth in itertools.count():
        front.repartition("dir_id", "path").mapInArrow(_list, f"dir_id {kind}, root string, {ENTRY}").write.parquet(f"{to}/{depth}")
        front = spark.read.parquet(f"{to}/{depth}").where("kind = 'directory'").select("dir_id", "root", "path")
        if front.isEmpty():
            return spark.read.parquet(*[f"{to}/{d}" for d in range(depth + 1)])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = []
        for root, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            try:
                store, at = open_store(root)
                h = hashlib.sha256()
                with store.open_input_stream(f"{at.rstrip('/')}/{path}", compression=None) as f:
                    while block := f.read(HASH_BLOCK):
                        h.update(block)
                digests.append(h.hexdigest())
            except OSError:
                digests.append(None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=[*b.schema.names, "sha256"])


def directory_inventory(roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(inventory, uncertain, opaque, issues) of the ``root`` of each ``dir_id``, as the directory checks take them.

    ``inventory``: dir_id, path, kind (file or directory), size_bytes, sha256, mtime; files are hashed by blocks of
    ``HASH_BLOCK`` bytes, null if that fails. ``uncertain``: dir_id, prefix that couldn't be read; ``opaque``: dir_id, path of
    links and special files. ``issues``: subject_id, kind, code, location of what can't be verified: unreadable
    places, links, special files, and files with further links.
    """
    found = list_directories(roots)
    kind = dict(found.dtypes)["dir_id"]
    files = found.where("kind = 'file'").select("dir_id", "root", "path", "size_bytes", "mtime").repartition("dir_id", "path")
    hashed = files.mapInArrow(_hash, f"dir_id {kind}, root string, path string, size_bytes long, mtime timestamp, sha256 string")
    none = F.lit(None).cast("string")
    inventory = hashed.select("dir_id", "path", F.lit("file").alias("kind"), "size_bytes", "sha256", "mtime").unionByName(found.where("kind = 'directory'").select("dir_id", "path", "kind", "size_bytes", none.alias("sha256"), "mtime"))
    uncertain = found.where("kind = 'error'").select("dir_id", F.col("path").alias("prefix"))
    opaque = found.where("kind IN ('link', 'other')").select("dir_id", "path")
    code = F.when(F.col("links") > 1, "directory-hardlink-unverified")
    for k, c in UNVERIFIED_KINDS.items():
        code = F.when(F.col("kind") == k, c).otherwise(code)
    issues = found.select(F.col("dir_id").cast("string").alias("subject_id"), F.lit("unverified").alias("kind"), code.alias("code"), F.when(F.col("path") == "", ".").otherwise(F.col("path")).alias("location")).where("code IS NOT NULL")
    return inventory, uncertain, opaque, issues
