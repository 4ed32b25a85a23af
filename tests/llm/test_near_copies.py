"""The pipeline's near-duplicates against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from runloom.llm import near_copies
from tests.llm.test_operators import docs_frame, reach


def plain_set(t: str | None) -> frozenset:
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_rows() -> list[tuple[int | None, str | None]]:
    """Near copies with different numbers of words changed, a large group of them, and texts with a common line."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(900)}"
    licence = [word() for _ in range(12)]
    texts: list[str | None] = [None, "", " \n", "one two", "One  two", "one three"]
    for group, copies in [(20, 3), (1, 90)]:
        for _ in range(group):
            base = [word() for _ in range(rng.choice([60, 150]))]
            for _ in range(copies):
                own = list(base)
                for _ in range(rng.choice([0, 1, 2, 3])):
                    own[rng.randrange(len(own))] = word()
                texts.append(" ".join(own))
    texts += [" ".join(licence + [word() for _ in range(rng.choice([1, 2, 40]))]) for _ in range(80)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    return [*rows, (None, texts[10]), (None, "alone"), (7, texts[30])]


@pytest.mark.parametrize("dense", [2, 64])
def test_near_copies_equal_all_pairs(spark, dense):
    rows = near_rows()
    live = [(i, t) for i, t in rows if i is not None]
    sets = [plain_set(t) for _, t in live]
    same = lambda a, b: live[a][0] == live[b][0] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = reach(len(live), [(a, b) for a in range(len(live)) for b in range(a) if same(a, b)])
    least = {c: min(live[k][0] for k in range(len(live)) if comp[k] == c) for c in comp}
    want = [(i, least[c]) for (i, _), c in zip(live, comp)]
    got = [(r.id, r.component) for r in near_copies.near_duplicates(docs_frame(spark, rows), dense=dense).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(want)
    assert sorted((x[1] is None, x[1]) for x in got if x[0] is None) == [(False, dict(want)[10]), (True, None)]


def test_pipeline_drops_near_copies(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(5000)}" for _ in range(200)]
    near = [*words[:50], "other", *words[51:120], "another", *words[121:]]
    far = [w if k % 9 else "changed" for k, w in enumerate(words)]
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in enumerate([words, near, far])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_hubs_and_frequent_keys_are_split(spark, monkeypatch):
    """The same links when a bucket takes few pairs, so that one text's pairs are dealt to many, and keys to many tasks."""
    for name, value in (("PAIRS", 7), ("OFTEN", 2), ("SALTS", 5), ("SALT_ROWS", 3), ("TILE", 8)):
        monkeypatch.setattr(near_copies, name, value)
    rows = near_rows()
    want = {(r.id, r.component) for r in near_copies.near_duplicates(docs_frame(spark, rows), dense=4).collect()}
    monkeypatch.undo()
    assert want == {(r.id, r.component) for r in near_copies.near_duplicates(docs_frame(spark, rows)).collect()}


def test_a_hub_goes_to_many_buckets(spark):
    """The second node of a thousand pairs doesn't take them all into one bucket."""
    from pyspark.sql import functions as F

    pairs = spark.range(2000).select(F.col("id").alias("u"), F.lit(5000).cast("long").alias("v"))
    dealt = near_copies.dealt(pairs, 2000)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 3 and max(sizes) <= 3 * near_copies.PAIRS
