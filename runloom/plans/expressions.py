"""Column expressions (EXP) and secret scans (SEC) over documents, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import exprs as X
from runloom.operators import secrets
from runloom.plans.registry import Tables, query

PATH = "regexp_replace(url, '^[a-z]+://[^/]*', '')"


@query("SELECT doc_id, regexp_matches(source, '^[^\\s\\p{Z}\\p{C}]+$') AS source_ok, regexp_matches(text, '^[^\\s\\p{Z}\\p{C}]+$') AS text_ok FROM documents")
def exp1_is_identifier(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.is_identifier(F.col("source")).alias("source_ok"), X.is_identifier(F.col("text")).alias("text_ok"))


@query("SELECT doc_id, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS digest_ok, regexp_matches(upper(sha256(text)), '^[0-9a-f]{64}$') AS upper_ok, regexp_matches(source, '^[0-9a-f]{64}$') AS source_ok FROM documents")
def exp2_is_digest(t: Tables) -> DataFrame:
    d = F.sha2("text", 256)
    return t.documents.select("doc_id", X.is_digest(d).alias("digest_ok"), X.is_digest(F.upper(d)).alias("upper_ok"), X.is_digest(F.col("source")).alias("source_ok"))


@query("SELECT doc_id, regexp_matches(source || CASE WHEN doc_id % 3 = 0 THEN ':' WHEN doc_id % 3 = 1 THEN '' ELSE ':x:' END || lang, '^[^\\s\\p{Z}\\p{C}:]+:[^\\s\\p{Z}\\p{C}:]+$') AS key_ok FROM documents")
def exp3_is_namespaced(t: Tables) -> DataFrame:
    glue = F.when(F.col("doc_id") % 3 == 0, ":").when(F.col("doc_id") % 3 == 1, "").otherwise(":x:")
    return t.documents.select("doc_id", X.is_namespaced(F.concat("source", glue, "lang")).alias("key_ok"))


SECRET_SQL = "'" + "|".join(X.SECRET_WORDS) + "'"


@query(f"SELECT doc_id, regexp_matches(regexp_replace(lower(lang || CASE WHEN doc_id % 4 = 0 THEN '-Api_Key' WHEN doc_id % 4 = 1 THEN '.pass.word' WHEN doc_id % 4 = 2 THEN '_name' ELSE source END), '[^a-z0-9]', '', 'g'), {SECRET_SQL}) AS secret FROM documents")
def exp4_is_secret_key(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 4
    key = F.concat("lang", F.when(m == 0, "-Api_Key").when(m == 1, ".pass.word").when(m == 2, "_name").otherwise(F.col("source")))
    return t.documents.select("doc_id", X.is_secret_key(key).alias("secret"))


@query("SELECT page_id, len(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x LIKE 'ref=%' OR x LIKE 'utm_source=%')) > 0 AS secret FROM pages")
def exp5_secret_value(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.has_secret_value(F.col("url"), ("ref", "utm_source")).alias("secret"))


@query(f"SELECT page_id, p <> '' AND NOT regexp_matches(p, '[\\x00-\\x1F\\x7F\\\\~]|\\$([A-Za-z_]|\\{{)') AND NOT starts_with(p, '//') AND NOT regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:') AS path_ok, NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS url_ok FROM (SELECT page_id, url, {PATH} AS p FROM pages)")
def exp6_path_ok(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.path_ok(F.expr(PATH)).alias("path_ok"), X.path_ok(F.col("url")).alias("url_ok"))


@query(f"SELECT page_id, '/' || array_to_string(list_concat(CASE WHEN len(s) > 1 THEN list_slice(s, 1, len(s) - 1) ELSE [] END, ['x', 'y']), '/') AS absolute, '/base/' || array_to_string(s, '/') AS relative FROM (SELECT page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS s FROM pages)")
def exp7_lexical_abspath(t: Tables) -> DataFrame:
    p = F.expr(PATH)
    return t.pages.select("page_id", X.lexical_abspath(F.concat(p, F.lit("/../x/./y")), "/b").alias("absolute"), X.lexical_abspath(F.regexp_replace(p, "^/", ""), "/base").alias("relative"))


@query(f"SELECT page_id, m <> '' AND trim(m) = m AND NOT regexp_matches(m, '[\\x00-\\x1F\\x7F\\\\~]') AND NOT starts_with(m, '/') AND len(list_filter(string_split(m, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS member_ok FROM (SELECT page_id, regexp_replace({PATH}, '^/', '') AS m FROM pages)")
def exp8_member_path_ok(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.member_path_ok(F.regexp_replace(F.expr(PATH), "^/", "")).alias("member_ok"))


@query("SELECT o_orderkey, CASE WHEN try_strptime(raw, '%Y%m%d') IS NOT NULL THEN substr(raw, 1, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2) END AS day FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS raw FROM orders)")
def exp9_iso_date(t: Tables) -> DataFrame:
    raw = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0"))
    return t.orders.select("o_orderkey", X.iso_date(raw).alias("day"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sentinel-1' WHEN 1 THEN 'Sentinel-1A' WHEN 2 THEN 'Sentinel-1B' WHEN 3 THEN 'Sentinel-1C' WHEN 4 THEN 'Sentinel-1D' ELSE event_type END AS platform FROM events")
def exp10_canonical_alias(t: Tables) -> DataFrame:
    short = F.element_at(F.array(*map(F.lit, ("S1", "S1A", "S1B", "S1C", "S1D"))), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", X.canonical_alias(F.when(F.col("event_id") % 6 < 5, short).otherwise(F.col("event_type")), "platform").alias("platform"))


@query("""SELECT d.doc_id, trim(text) <> '' AND length(text) <= 128 AND NOT regexp_matches(text, '[\\n\\r\\x0B\\x0C]') AS label_ok,
  CASE WHEN l.doc_id IS NOT NULL THEN l.quality IS NOT NULL ELSE d.doc_id % 2 = 0 END AS semantic_ok,
  CASE d.doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS nodata_ok
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def exp11_value_rules(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    status = F.when(F.col("labelled"), "known").otherwise("unknown")
    reason = F.when(F.col("labelled").isNull() & (F.col("doc_id") % 2 == 0), F.lit("UNLABELLED"))
    m = F.col("doc_id") % 4
    kind = F.when(m == 0, "none").when(m == 1, "finite_value").when(m == 2, "mask").otherwise("nan")
    nodata = X.nodata_ok(kind, F.when(m.isin(1, 2), F.col("n_chars").cast("double")), F.lit(None).cast("string"))
    return d.select("doc_id", X.label_ok(F.col("text")).alias("label_ok"), X.semantic_ok(status, F.col("quality"), reason).alias("semantic_ok"), nodata.alias("nodata_ok"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN sha256(event_type) END AS value, event_id % 3 = 0 AS reusable,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'INPUT_WEAK,PURGED' ELSE 'INPUT_WEAK' END AS reasons FROM events""")
def exp12_fingerprint(t: Tables) -> DataFrame:
    m = F.col("event_id") % 3
    weak, gone = F.lit("INPUT_WEAK"), F.lit("PURGED")
    none = F.array().cast("array<string>")
    got = X.fingerprint_struct(F.sha2("event_type", 256), F.when(m == 0, none).when(m == 1, F.array(gone, weak, gone)).otherwise(F.array(weak, F.lit("not a code"))))
    return t.events.select("event_id", got.alias("f")).select("event_id", "f.value", "f.reusable", F.array_join("f.reasons", ",").alias("reasons"))


@query(f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN NOT regexp_matches(p, '//') AND len(list_filter(string_split(p[2:], '/'), lambda x: x IN ('', '.', '..'))) = 0 ELSE NOT starts_with(p, '//') END AS location_ok
FROM (SELECT page_id, url, {PATH} AS p FROM pages)""")
def exp13_location_ok(t: Tables) -> DataFrame:
    m, p = F.col("page_id") % 3, F.expr(PATH)
    kind = F.when(m == 0, "remote_reference").when(m == 1, "manifest_relative").otherwise("absolute_local")
    value = F.when(m == 0, F.col("url")).when(m == 1, F.substr(p, F.lit(2))).otherwise(p)
    return t.pages.select("page_id", X.location_ok(kind, value, F.when(m == 1, F.lit("/data"))).alias("location_ok"))


@query("SELECT DISTINCT source, sha256(source) AS path_key FROM documents")
def exp14_path_key(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select("source", X.path_key(F.col("source")).alias("path_key"))


@query("""SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, CASE WHEN event_id % 5 = 0 THEN 'secret-key' ELSE 'secret-value' END AS code, 'doc' AS location
FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0""")
def sec1_scan_nested(t: Tables) -> DataFrame:
    key = F.when(F.col("event_id") % 5 == 0, "accessToken").otherwise("authentication_required")
    value = F.when(F.col("event_id") % 7 == 0, '"ftp://user:x@host/"').otherwise("true")
    value = F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 7 == 0), F.lit('true,"link":"ftp://user:x@host/"')).otherwise(value)
    doc = F.concat(F.lit('{"props":'), "props", F.lit(',"nested":{"'), key, F.lit('":'), value, F.lit("}}"))
    return secrets.scan_nested(t.events.select("event_id", doc.alias("doc")), "event_id", "doc")


@query("""SELECT CAST(doc_id AS VARCHAR) AS subject_id, 'error' AS kind, 'secret-key' AS code, CAST(n AS VARCHAR) AS location
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE regexp_matches(line, '(?i)(token|secret|password|passwd)["'']?\\s*[:=]\\s*\\S')""")
def sec2_scan_lines(t: Tables) -> DataFrame:
    return secrets.scan_lines(t.documents, "doc_id", "text", anchored=False)
