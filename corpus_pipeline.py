"""A corpus pipeline over ``documents``: language, near-duplicates, contamination, private data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``. Texts are not shuffled for
verdicts: only rows with an exceptional verdict are gathered, and up to ``SENT_ROWS`` of them travel to the
documents; beyond that Spark joins both by shuffles. The stages bound the Arrow batches of their session to
``BATCH_BYTES``, unless it already has a bound other than Spark's own; :func:`run` puts the session's back. Verdicts are joined by a 128-bit hash of the row
(``_KEY``), so rows without an id and repeated ids are handled, or by the id. Further columns of ``docs``
are dropped only by the last stage; none may be named ``corpus_pipeline_row`` or ``corpus_pipeline_pii``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm import bpe, decontam, langid, near_copies, pii
from runloom.llm.common import checkpointed, shared_folder, table
from runloom.llm.queries import pii_key

_KEY = "corpus_pipeline_row"
#: Up to so many verdicts, of some 50 bytes each, are broadcast; their number is counted first.
SENT_ROWS = 1_000_000
#: Bytes of an Arrow batch; Spark's 64 MB take several times that in the executor and again in its Python worker.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCHES) == "67108864b":
            spark.conf.set(_BATCHES, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    row = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    return docs.withColumn(_KEY, F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b")))


def _sized(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` written down, to be broadcast if they are few enough."""
    verdicts = checkpointed(verdicts)
    return F.broadcast(verdicts) if verdicts.count() <= SENT_ROWS else verdicts


@_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with ``lang`` set to it.

    The declared language is the column ``lang``, the host is ``source``; text models are fitted on a
    bounded sample of labelled rows. A document goes only if it has next to no letters or if no
    language gets most of the evidence. Exceptional verdicts are those other than the declared language.
    """
    rows = _keyed(docs)
    found = langid.identify(rows, langid.fit(docs), _KEY, "text", F.col("lang"), F.lit(None), F.col("source"))
    odd = found.where("lang IS NULL OR lang <> declared").groupBy("id").agg(F.max("lang").alias("told"))
    odd = odd.select(F.struct(F.col("id").alias("key"), "told").alias("corpus_pipeline_odd"))
    joined = rows.join(_sized(odd), F.col(_KEY) == F.col("corpus_pipeline_odd.key"), "left")
    told = F.coalesce(F.col("corpus_pipeline_odd.told"), langid.language_tag(F.col("lang")))
    kept = joined.where(F.col("corpus_pipeline_odd").isNull() | F.col("corpus_pipeline_odd.told").isNotNull())
    return kept.select(*[told.alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Near-duplicates have a Jaccard similarity of at least 0.8 on shingles of five words.
    Rows without an id stay, as no group can be named after them; of repeated ids one row stays.
    """
    found = checkpointed(near_copies.near_duplicates(docs.select("doc_id", "text"), shingle=5, threshold=0.8).where("id IS NOT NULL"))
    kept = docs.join(_sized(found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_anti").select(*docs.columns)
    again = _sized(found.where("id = component").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    once = kept.join(again, "doc_id", "left_semi").withColumn(_KEY, F.row_number().over(order)).where(F.col(_KEY) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


@_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    rows = _keyed(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark", "item_id", "text"), _KEY, "text")
    hit = found.where("n_hit > 0").select(F.col("id").alias(_KEY)).distinct()
    return rows.join(_sized(hit), _KEY, "left_anti").select(*docs.columns)


@_small_batches
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced by pseudonyms of the same format; ``n_chars`` follows."""
    out = pii.transform(docs, pii_key(spark), "text", "corpus_pipeline_pii").drop("corpus_pipeline_pii")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_small_batches
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents (little-endian unsigned 32-bit), with digests of ids and decoded text."""
    out = bpe.encode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, with_decoded=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonymise", pseudonymise),
    ("tokenise", tokenise),
]

#: SQL has neither the trigram models nor XXH64; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared checkpoint folder and read again."""
    to = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCHES)
    try:
        for n, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{to}/{n}-{name}")
            docs = spark.read.parquet(f"{to}/{n}-{name}")
    finally:
        spark.conf.set(_BATCHES, before)
    return docs
