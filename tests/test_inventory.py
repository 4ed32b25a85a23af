"""Digests of files that aren't loaded whole."""

from __future__ import annotations

import hashlib
import os

from runloom.sources import records


def test_large_files_have_digests(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    content = {"a b/large 1%.bin": os.urandom((5 << 19) + 7), "exact.bin": os.urandom(2 << 20), "small.bin": b"x" * 10}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.size_bytes, r.sha256) for r in records.read_inventory(spark, f"file://{tmp_path}", max_bytes=100).collect()}
    assert sorted(got.values()) == sorted((len(x), hashlib.sha256(x).hexdigest()) for x in content.values())
