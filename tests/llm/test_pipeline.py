"""The pipeline against a plain version of each stage, and the driver's registry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from runloom.llm import langid, pii
from runloom.llm.queries import pii_key
from tests.llm.test_operators import WORDS, language_rows, plain_contamination, plain_fingerprint, reach


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, t + f" nr {i}", x) for i, t, x in language_rows(40)]
    bench = " ".join(rng.choice(WORDS) + str(k) for k in range(14))
    rows += [(50, f"Some words before. {bench} and after.", "en"), (51, rows[0][1], "en"), (52, "", "en"), (53, "4242 !!", "en"), (54, None, "de"), (55, "mail me at a.b12@x.example.com, it is the best of all that you can do", "en"), (55, "mail me at a.b12@x.example.com, it is the best of all that you can do", "en")]
    rows += [(None, "they had to be at the one that was for all of them " + str(rng.random()), "en")]
    to = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, x, "s0", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to), rows, bench


def test_stages(spark, sf_dir):
    path, rows, bench = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    told = corpus_pipeline.language(spark, docs, path)
    assert told.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in told.collect()) == sorted((i or -1) for i, _, _ in rows if i not in (52, 53, 54)), "only documents without letters go"
    kept = corpus_pipeline.near_duplicates(spark, told, path)
    live = [(i, t) for i, t, _ in rows if i not in (52, 53, 54) and i is not None]
    fps = [plain_fingerprint(t) for _, t in live]
    comp = reach(len(live), [(a, b) for a in range(len(live)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = {min(live[j][0] for j in range(len(live)) if comp[j] == comp[k]) for k in range(len(live))}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want) and kept.where("doc_id IS NULL").count() == 1
    clean = corpus_pipeline.decontaminate(spark, kept, path)
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()} == {50}
    assert plain_contamination(rows[40][1], [(1, bench)])[1] > 0
    hidden = corpus_pipeline.pseudonymise(spark, clean, path)
    key = pii_key(spark)
    for r in hidden.collect():
        t = next(t for i, t, _ in rows if i == r.doc_id)
        assert r.text == pii.pseudonymise(t, key)[0] and r.n_chars == len(r.text)
    out = corpus_pipeline.tokenise(spark, hidden, path)
    assert out.count() == hidden.count() and out.where("n_tokens = 0").count() == 0


def test_run_and_registry(spark, sf_dir):
    path, _, _ = sf_dir
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "pseudonymise", "tokenise"]
    rows = corpus_pipeline.run(spark, path).collect()
    assert 50 not in {r.doc_id for r in rows} and 0 in {r.doc_id for r in rows}
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert corpus_pipeline.run(spark, path).count() == len(rows)


def test_clashing_and_further_columns(spark, sf_dir):
    path, rows, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = docs
    for c in ("n", "told", "id", "component", "key", "odd", "t", "kind"):
        more = more.withColumn(c, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, path), stage(spark, more, path)
        assert wide.columns == more.columns
        assert sorted(wide.select(*docs.columns).collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert corpus_pipeline.tokenise(spark, more, path).count() == len(rows)


def test_language_labels_are_those_of_the_operator(spark, sf_dir):
    path, rows, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")))
    found = langid.identify(docs, langid.fit(docs), "doc_id", "text", F.col("lang"), F.lit(None), F.col("source"))
    want = sorted((r.id if r.id is not None else -1, r.lang) for r in found.where("lang IS NOT NULL").collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.lang) for r in corpus_pipeline.language(spark, docs, path).collect()) == want


def test_verdicts_join_alike_without_a_broadcast(spark, sf_dir, monkeypatch):
    path, _, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = [s for _, s in corpus_pipeline.STAGES[:3]]
    sent = [sorted(s(spark, docs, path).collect(), key=repr) for s in stages]
    monkeypatch.setattr(corpus_pipeline, "SENT_ROWS", -1)
    assert [sorted(s(spark, docs, path).collect(), key=repr) for s in stages] == sent


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
