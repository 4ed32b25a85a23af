"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text under a byte-trigram model of each
language, the language that the markup declares, the one that the address ends in (country suffix or a
path segment), and a prior for the host. Host priors are smoothed hierarchically, corpus to site to
host, from sums of all rows' posteriors computed by grouped aggregation; a row's own posterior is left
out of its host's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed, hashed_sample

#: Labelled rows, about, that the trigram models are fitted on, chosen by a hash of all their columns.
SAMPLE_ROWS = 4_000
#: Sampled rows without which a language has no model; so there are at most SAMPLE_ROWS / LEAST_ROWS or so models.
LEAST_ROWS = 10
#: Slots that byte trigrams are hashed to, pseudo-count of a slot.
SLOTS, SMOOTH = 1 << 16, 0.05
#: A text's likelihood counts as that of this many trigrams at most: they are far from independent.
TEXT_WEIGHT = 60.0
#: Chance that the declared language, and the address, tell the truth.
DECLARED_TRUE, ADDRESS_TRUE = 0.90, 0.80
#: Rows that the next higher level of the host hierarchy counts as.
HOST_WEIGHT, SITE_WEIGHT = 5.0, 20.0
#: Rows whose best language has a smaller posterior, or with fewer trigrams of letters, have none.
LEAST_POSTERIOR, LEAST_TRIGRAMS = 0.5, 3

#: Non-letters become spaces; bytes of non-ASCII characters stay.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slots(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters of a text that hold two letters or more."""
    raw = np.frombuffer(f" {text or ''} ".lower().encode().translate(_LETTERS), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.uint32)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    h = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
    return h[(a == 32).astype(np.uint8) + (b == 32) + (c == 32) < 2]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = sums.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
            n += np.bincount(slots(text), minlength=SLOTS)
    for lang, n in sums.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["lang", "slot", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Log-likelihoods per language and slot, from a bounded sample of whole labelled texts.

    A language needs ``LEAST_ROWS`` rows in the sample, which bounds the number of models on the driver.
    Rows without a text or language are left out; without any labelled row there are no languages. Pass a
    column that tells rows apart (an id), so that copies of one text are chosen one by one. Texts stay
    where they are: each task counts the slots of its own chosen rows, and only counts, of ``SLOTS``
    slots per language and task, are moved.
    """
    told = F.lower(F.trim(F.col(lang_col).cast("string"))) != ""
    chosen = hashed_sample(labelled.where(told), labelled.columns, sample_rows, labelled.where(told).select(lang_col).count())
    rows = chosen.select(F.lower(F.trim(F.col(lang_col).cast("string"))).alias("lang"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    enough = [r.lang for r in rows.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).collect()]
    rows = rows.where(F.col("lang").isin(*enough)) if enough else rows.limit(0)
    counted = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for r in counted.collect():
        sums.setdefault(r.lang, np.zeros(SLOTS, dtype=np.int64))[r.slot] = r.n
    return {lang: np.log((n + SMOOTH) / (n.sum() + SMOOTH * SLOTS)) for lang, n in sorted(sums.items())}


def _evidence(langs: list[str], table: np.ndarray, html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            if html:
                from runloom.llm.html_text import blocks, extract

                texts = [extract(t) or " ".join(x.text for x in blocks(t or "")) for t in texts]
            score, n = [], []
            for t in texts:
                h = slots(t)
                n.append(len(h))
                ll = table[h].sum(axis=0, dtype=np.float64) if len(h) else np.zeros(len(langs))
                score.append((ll * min(1.0, TEXT_WEIGHT / max(1, len(h)))).tolist())
            cols = [b.column(0), *b.columns[2:], pa.array(score, pa.list_(pa.float64())), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[b.schema.names[0], *b.schema.names[2:], "text_score", "n_trigrams"])

    return run


def _normal(log_weights: Column) -> Column:
    """An array of logarithms as probabilities."""
    e = F.transform(log_weights, lambda x: F.exp(x - F.array_max(log_weights)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _told(column: str, langs: list[str], truth: float) -> Column:
    """Log-likelihood of a told language under each; nothing if it isn't one of them."""
    rest = (1 - truth) / max(1, len(langs) - 1)
    each = [F.when(F.col(column) == lang, float(np.log(truth))).otherwise(float(np.log(max(rest, 1e-9)))) for lang in langs]
    return F.when(F.col(column).isin(*langs), F.array(*each)).otherwise(F.array(*[F.lit(0.0)] * len(langs)))


def _add(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def language_tag(declared: Column) -> Column:
    """The first part of a language tag, lower-cased; the empty text if it has none of two or three letters."""
    return F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})", 1))


def identify(rows: DataFrame, models: dict[str, np.ndarray], id_col: str, text_col: str, declared: Column, address: Column, host: Column, html: bool = False) -> DataFrame:
    """Per row: ``id, lang, posterior, declared, address, host, n_trigrams``.

    ``declared`` is a language tag (only its first part counts), ``address`` a language code or null,
    ``host`` a dotted name or null. ``lang`` is null where nothing decides: fewer than
    ``LEAST_TRIGRAMS`` trigrams of letters, or no posterior of ``LEAST_POSTERIOR``. A null or empty text
    adds no evidence and has no language, whatever it declares. Repeated rows count repeatedly in the
    priors. Without models every row is without a language.

    Only sums per host and per site are shuffled, partially summed in the tasks. Ties go to the language
    that sorts first.
    """
    picked = rows.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("t"),
        language_tag(declared).alias("declared"),
        F.lower(F.coalesce(address.cast("string"), F.lit(""))).alias("address"),
        F.lower(F.coalesce(host.cast("string"), F.lit(""))).alias("host"),
    )
    kind = dict(picked.dtypes)["id"]
    langs = sorted(models)
    if not langs:
        nothing = F.lit(None)
        return picked.select("id", nothing.cast("string").alias("lang"), nothing.cast("double").alias("posterior"), "declared", "address", "host", F.lit(0).cast("long").alias("n_trigrams"))
    table = np.stack([models[x] for x in langs], axis=1).astype(np.float32)
    table -= table.mean(axis=1, keepdims=True)  # only differences matter; keeps sums small
    n = len(langs)
    seen = picked.mapInArrow(_evidence(langs, table, html), f"id {kind}, declared string, address string, host string, text_score array<double>, n_trigrams long")
    own = _add(F.col("text_score"), _told("declared", langs, DECLARED_TRUE), _told("address", langs, ADDRESS_TRUE))
    site = F.coalesce(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(""))
    seen = seen.withColumn("own", own).withColumn("p", _normal(F.col("own")))
    seen = seen.withColumn("site", F.when(site == "", F.col("host")).otherwise(site)).withColumn("counts", F.col("n_trigrams") >= LEAST_TRIGRAMS)
    seen = checkpointed(seen.drop("text_score"))
    part = seen.where("counts")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    hosts = part.groupBy("host", "site").agg(*sums)
    sites = hosts.groupBy("site").agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(n)])
    whole = sites.agg(*[F.coalesce(F.sum(f"t{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(n)]).first()
    total = sum(whole)
    corpus = [(g + 1.0) / (total + n) for g in whole]
    prior = hosts.join(sites, "site")
    t_all = sum(F.col(f"t{i}") for i in range(1, n)) + F.col("t0") if n > 1 else F.col("t0")
    site_prior = [(F.col(f"t{i}") + SITE_WEIGHT * corpus[i]) / (t_all + SITE_WEIGHT) for i in range(n)]
    prior = prior.select("host", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("host_sum"), F.array(*site_prior).alias("site_prior"))
    both = seen.join(prior, "host", "left")
    zero, flat = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(float(c)) for c in corpus])
    less = F.when(F.col("counts"), F.col("p")).otherwise(zero)
    others = F.zip_with(F.coalesce("host_sum", zero), less, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    smoothed = F.zip_with(others, F.coalesce("site_prior", flat), lambda s, q: F.log(s + HOST_WEIGHT * q))
    both = both.withColumn("post", _normal(_add(F.col("own"), smoothed)))
    best = F.array_max("post")
    decided = F.col("counts") & (best >= LEAST_POSTERIOR)
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("post", best).cast("int"))
    return both.select("id", F.when(decided, name).alias("lang"), F.when(F.col("counts"), best).alias("posterior"), "declared", "address", "host", "n_trigrams")


def page_columns(url: str = "url", html: str = "html") -> tuple[Column, Column, Column]:
    """(declared, address, host) of web pages: the lang of the first html element outside comments, wherever it begins, the first two-letter path segment
    or else the two-letter suffix of the host, and the host without its port."""
    shown = F.regexp_replace(html, r"(?s)<!--(?:-?>|.*?(?:--!?>|\z))", " ")
    tag = F.regexp_extract(shown, r"(?i)<html(?=[\s/>])[^>]*", 0)
    declared = F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return declared, F.when(path != "", path).otherwise(suffix), host
