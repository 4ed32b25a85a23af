"""Directories as tasks list them: empty ones, links, special files, what can't be read, and what the checks make of it."""

from __future__ import annotations

import hashlib
import os

from runloom.operators import integrity
from runloom.sources import listing


def test_every_kind_of_entry(spark, tmp_path):
    a = tmp_path / "a"
    (a / "deep/er/est").mkdir(parents=True)
    (a / "deep/er/f g%20.txt").write_bytes(b"x" * 3_000_000)
    (a / "empty file").write_bytes(b"")
    (a / "one").write_bytes(b"1")
    os.link(a / "one", a / "two")
    os.symlink(a / "deep", a / "loop")
    os.symlink("/nowhere", a / "deep/gone")
    os.mkfifo(a / "pipe")
    (tmp_path / "b").mkdir()
    roots = [(1, f"file://{a}"), (2, str(tmp_path / "b")), (3, f"file://{tmp_path}/missing"), (4, f"file://{a}/one"), (None, f"file://{a}/deep/er/est"), (5, None)]
    inventory, uncertain, opaque, issues = listing.directory_inventory(spark.createDataFrame(roots, "dir_id long, root string"))
    got = {(r.dir_id, r.path): (r.kind, r.size_bytes, r.sha256) for r in inventory.collect()}
    file = lambda b: ("file", len(b), hashlib.sha256(b).hexdigest())
    directory = ("directory", None, None)
    assert got == {(1, "deep"): directory, (1, "deep/er"): directory, (1, "deep/er/est"): directory, (1, "deep/er/f g%20.txt"): file(b"x" * 3_000_000), (1, "empty file"): file(b""), (1, "one"): file(b"1"), (1, "two"): file(b"1")}
    assert {(r.dir_id, r.prefix) for r in uncertain.collect()} == {(3, ""), (4, ""), (5, "")}
    assert {(r.dir_id, r.path) for r in opaque.collect()} == {(1, "loop"), (1, "deep/gone"), (1, "pipe")}
    assert {(r.subject_id, r.code, r.location) for r in issues.collect()} == {
        ("1", "directory-hardlink-unverified", "one"), ("1", "directory-hardlink-unverified", "two"), ("1", "directory-symlink-unverified", "loop"), ("1", "directory-symlink-unverified", "deep/gone"), ("1", "directory-special-file-unverified", "pipe"),
        ("3", "directory-io-unverified", "."), ("4", "directory-io-unverified", "."), ("5", "directory-io-unverified", "."),
    }


def test_missing_members_below_unread_places_are_not_reported(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    roots = spark.createDataFrame([(1, f"file://{tmp_path}/ok"), (2, f"file://{tmp_path}/none")], "dir_id long, root string")
    inventory, uncertain, opaque, _ = listing.directory_inventory(roots)
    members = spark.createDataFrame([(d, "x/y", "file", 1, "sha256", "0" * 64) for d in (1, 2)], "dir_id long, path string, member_kind string, size_bytes long, algorithm string, digest string")
    left = integrity.suppress_uncertain(integrity.reconcile_directory(members, inventory), uncertain, opaque)
    assert [(r.subject_id, r.code) for r in left.collect()] == [("1", "member-missing")]


def test_no_roots(spark):
    assert listing.list_directories(spark.createDataFrame([], "dir_id string, root string")).count() == 0


def test_facts_are_read_by_tasks_once_for_all_kinds(spark, tmp_path):
    """Nothing of a fact file goes through the driver's file index; names and paths are those of Spark's readers."""
    from runloom.sources import records

    for at in ("runs/a b/summary.json", "runs/_x/summary.json", "runs/r/.hidden.json", "runs/r/transitions/1.json", "runs/r/other.txt"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text('{"schema_version":2,"kind":"transition","payload":{"task_id":"t","state":"running"}}')
    texts = records.fact_texts(spark, f"file://{tmp_path}")
    seen = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(str(tmp_path)).selectExpr("input_file_name()", "value")
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, seen.collect())) and texts.count() == 2
    facts, refused = records.read_facts(spark, str(tmp_path), "transition", texts=texts)
    assert facts.count() == 1 and refused.count() == 0 and not any(f.endswith(".json") for f in facts.inputFiles())
    assert records.read_facts(spark, str(tmp_path), "summary", texts=texts)[1].count() == 1
