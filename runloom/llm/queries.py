"""One query per operator, with production parameters, over whole given tables."""

from __future__ import annotations

import hashlib
import uuid
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import bpe, decontam, embeddings, html_text, langid, ngram_lm, pii, secrets, simhash, toxicity, variants, warc, whitening
from runloom.llm.common import shared_folder, table


def pii_key(spark: SparkSession) -> bytes:
    """The pseudonym key of the session: its ``spark.runloom.pii.key``, of at least 16 characters.

    There is no built-in key. Where none is set a random one is drawn for the session, so pseudonyms are
    linked within it but can't be told from outside. A key is hashed to 64 bytes.
    """
    name = "spark.runloom.pii.key"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, token_hex(32))
    text = spark.conf.get(name)
    if len(text) < 16:
        raise ValueError(f"{name} is too short")
    return hashlib.blake2b(text.encode()).digest()


def op1_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", *[F.col("counts")[i].alias(f"n_{p}") for i, p in enumerate(toxicity.PATTERNS)])


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.transform(table(spark, sf_dir, "documents", "doc_id", "text"), pii_key(spark))
    n = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", F.size("pii").cast("long").alias("n_found"), *map(n, pii.KINDS), "text")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "html", "url")
    return out.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = bpe.encode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, with_ids=False, with_decoded=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = spark.conf.get("spark.runloom.secrets.ledger", None) or f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    out = secrets.incremental(table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    span = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"].isin(*secrets.BASE))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        F.col("id").alias("doc_id"),
        *[n(k) for k in secrets.BASE],
        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", span), ",").alias("spans"),
    )


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = langid.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    out = langid.identify(pages, models, "page_id", "html", *langid.page_columns(), html=True)
    return out.select(F.col("id").alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "declared", "address", "host", "n_trigrams")


def op11_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.page_records(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    found = warc.index(warc.write(records, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")).where("record_type IN ('response', 'revisit')")
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents", "doc_id", "text")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_sorted_projections, op2_simhash_pigeonring, op3_decontamination, op4_ngram_trie, op5_toxicity_grammar,
        op6_pii_feistel, op7_main_text, op8_byte_bpe, op9_secret_ledger, op10_language_fusion,
        op11_warc_ranges, op12_spelling_variants, op13_whitening,
    )}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All pairs by cosine, and everything reachable from each vector.
OP1_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS kept FROM embeddings"""

#: Windows of items and of documents, of every length that items have, joined as texts.
OP3_SQL = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.s = dw.s AND bw.n = dw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""


#: What is written is read back: sizes and digests of the pages' bytes, and the largest id of equal payloads.
OP11_SQL = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS b, sha1(coalesce(html, '')) AS d, sha256(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY s) END AS last FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM m"""

#: Near words share what remains when a letter is left out: at the same place (replaced), or of one of them only (inserted).
#: CRC-32 byte by byte, from its table.
OP12_SQL = f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT d, w, count(*) AS n, list_transform(string_split(d || ':' || w, ''), lambda c: ord(c)) AS cp FROM r GROUP BY d, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(cp, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END))), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS h FROM g, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2:] ELSE w END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.rest UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.rest),
s AS (SELECT a, count(*) AS n_near, max(bn) AS top, arg_min(b, (-bn, b)) AS best FROM e GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN best END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN s ON s.a = v.word),
w(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, w.root FROM f JOIN w ON f.form = w.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN w ON w.word = f.word"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sorted_projections": OP1_SQL, "op3_decontamination": OP3_SQL, "op11_warc_ranges": OP11_SQL, "op12_spelling_variants": OP12_SQL}
