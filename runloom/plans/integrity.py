"""Declared against observed (INT), with orders as what is declared and lineitems as what is observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import integrity, issues
from runloom.plans.registry import Tables, query

DECLARED = """d AS (SELECT CAST(o_orderkey % 100 AS VARCHAR) AS dir_id, 'f/' || CAST(o_orderkey % 7 AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'directory' ELSE 'file' END AS member_kind, o_custkey % 3 AS size_bytes,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'md5' ELSE 'SHA256' END AS algorithm,
  CASE WHEN o_orderpriority LIKE '4%' THEN NULL WHEN o_orderpriority LIKE '3%' THEN 'short' ELSE sha256(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus) END AS digest
  FROM orders WHERE o_orderstatus IN ('O', 'F')),
o AS (SELECT CAST(l_orderkey % 100 AS VARCHAR) AS dir_id, 'f/' || CAST(l_orderkey % 7 AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR) AS path,
  CASE WHEN count(*) >= 7 THEN 'directory' ELSE 'file' END AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) % 3 AS BIGINT) AS size_bytes, sha256(CAST(l_orderkey AS VARCHAR) || ':' || max(l_linestatus)) AS sha256
  FROM lineitem GROUP BY l_orderkey)"""
RECONCILED = f"""WITH {DECLARED},
j AS (SELECT coalesce(d.dir_id, o.dir_id) AS dir_id, coalesce(d.path, o.path) AS path, d.path IS NOT NULL AS m, o.path IS NOT NULL AS s, member_kind, kind, d.size_bytes AS ds, o.size_bytes AS os, algorithm, digest, sha256,
  d.path IS NOT NULL AND o.path IS NOT NULL AND member_kind = kind AND kind = 'file' AS f, coalesce(lower(algorithm) = 'sha256' AND digest IS NOT NULL, false) AS dg, coalesce(regexp_matches(lower(digest), '^[0-9a-f]{{64}}$'), false) AS ok
  FROM d FULL OUTER JOIN o ON d.dir_id = o.dir_id AND d.path = o.path),
i AS (SELECT dir_id, path, 'error' AS kind, 'member-missing' AS code FROM j WHERE NOT s
  UNION ALL SELECT dir_id, path, 'error', 'member-unexpected' FROM j WHERE NOT m
  UNION ALL SELECT dir_id, path, 'error', 'member-kind-mismatch' FROM j WHERE m AND s AND member_kind <> kind
  UNION ALL SELECT dir_id, path, 'error', 'member-invalid-sha256' FROM j WHERE f AND dg AND NOT ok
  UNION ALL SELECT dir_id, path, 'error', 'member-size-mismatch' FROM j WHERE f AND ds <> os AND NOT (dg AND NOT ok)
  UNION ALL SELECT dir_id, path, 'error', 'member-integrity-mismatch' FROM j WHERE f AND dg AND ok AND lower(digest) <> sha256
  UNION ALL SELECT dir_id, path, 'unverified', 'member-integrity-unverified' FROM j WHERE f AND NOT dg)"""


def members(t: Tables) -> DataFrame:
    o, p = t.orders.where(F.col("o_orderstatus").isin("O", "F")), F.col("o_orderpriority")
    return o.select(
        (F.col("o_orderkey") % 100).cast("string").alias("dir_id"),
        F.concat_ws("/", F.lit("f"), F.col("o_orderkey") % 7, "o_orderkey").alias("path"),
        F.when(p.startswith("1"), "directory").otherwise("file").alias("member_kind"),
        (F.col("o_custkey") % 3).alias("size_bytes"),
        F.when(p.startswith("5"), "md5").otherwise("SHA256").alias("algorithm"),
        F.when(p.startswith("4"), None).when(p.startswith("3"), "short").otherwise(F.sha2(F.concat_ws(":", "o_orderkey", "o_orderstatus"), 256)).alias("digest"),
    )


def inventory(t: Tables) -> DataFrame:
    seen = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.max("l_linestatus").alias("s"))
    return seen.select(
        (F.col("l_orderkey") % 100).cast("string").alias("dir_id"),
        F.concat_ws("/", F.lit("f"), F.col("l_orderkey") % 7, "l_orderkey").alias("path"),
        F.when(F.col("n") >= 7, "directory").otherwise("file").alias("kind"),
        (F.col("q") % 3).alias("size_bytes"),
        F.sha2(F.concat_ws(":", "l_orderkey", "s"), 256).alias("sha256"),
    )


@query(RECONCILED + " SELECT dir_id AS subject_id, kind, code, path AS location FROM i")
def int2_reconcile(t: Tables) -> DataFrame:
    return integrity.reconcile_directory(members(t), inventory(t))


@query(RECONCILED + """ SELECT d.dir_id AS subject_id, count(code) FILTER (i.kind = 'error') AS n_error, count(code) FILTER (i.kind = 'unverified') AS n_unverified,
  count(code) FILTER (i.kind = 'error') = 0 AS is_valid, count(code) = 0 AS is_fully_verified FROM (SELECT DISTINCT dir_id FROM d) d LEFT JOIN i ON i.dir_id = d.dir_id GROUP BY d.dir_id""")
def prd7_rollup_report(t: Tables) -> DataFrame:
    return issues.rollup(integrity.reconcile_directory(members(t), inventory(t)), members(t), "dir_id")


@query(RECONCILED + """ SELECT dir_id AS subject_id, kind, code, path AS location, row_number() OVER (PARTITION BY dir_id ORDER BY path,
  list_position(['member-missing','member-unexpected','member-kind-mismatch','member-invalid-sha256','member-size-mismatch','member-integrity-mismatch','member-integrity-unverified'], code)) AS issue_rank FROM i""")
def int4_order_directory_issues(t: Tables) -> DataFrame:
    return integrity.order_directory_issues(integrity.reconcile_directory(members(t), inventory(t)))


@query(RECONCILED + """ SELECT dir_id AS subject_id, kind, code, path AS location FROM i
WHERE NOT (code = 'member-missing' AND CAST(dir_id AS BIGINT) % 2 = 0 AND path LIKE 'f/3/%') AND NOT (CAST(dir_id AS BIGINT) % 5 = 0 AND path LIKE 'f/1/%')""")
def int3_suppress_uncertain(t: Tables) -> DataFrame:
    dirs = members(t).select("dir_id").distinct().unionByName(inventory(t).select("dir_id").distinct()).distinct()
    uncertain = dirs.where("int(dir_id) % 2 = 0").select("dir_id", F.lit("f/3").alias("prefix"))
    opaque = dirs.where("int(dir_id) % 5 = 0").select("dir_id", F.lit("f/1").alias("path"))
    return integrity.suppress_uncertain(integrity.reconcile_directory(members(t), inventory(t)), uncertain, opaque)


ASSETS = f"""WITH {DECLARED}, j AS (SELECT d.*, o.path AS op, kind, o.size_bytes AS os, sha256, CASE WHEN CAST(d.dir_id AS BIGINT) % 10 = 9 THEN 'remote_reference' ELSE 'absolute_local' END AS location_kind FROM d LEFT JOIN o ON d.path = o.path),
a AS (SELECT path, sha256, CASE WHEN location_kind = 'remote_reference' THEN 'uri-asset-unverified' WHEN op IS NULL THEN 'missing-local-asset' WHEN kind <> member_kind THEN 'asset-kind-mismatch'
  WHEN member_kind <> 'file' THEN 'directory-content-unverified' WHEN size_bytes <> os THEN 'file-size-mismatch' WHEN digest IS NULL THEN 'checksum-not-declared' WHEN lower(algorithm) <> 'sha256' THEN 'checksum-algorithm-unverified'
  WHEN NOT regexp_matches(lower(digest), '^[0-9a-f]{{64}}$') THEN 'invalid-sha256-checksum' WHEN lower(digest) <> sha256 THEN 'checksum-mismatch' END AS code FROM j)"""
UNVERIFIED = "('uri-asset-unverified', 'directory-content-unverified', 'checksum-not-declared', 'checksum-algorithm-unverified')"


def assets(t: Tables) -> DataFrame:
    kind = F.when(F.col("dir_id").cast("int") % 10 == 9, "remote_reference").otherwise("absolute_local")
    return members(t).withColumnRenamed("member_kind", "asset_kind").withColumn("location_kind", kind).withColumn("asset_id", F.col("path"))


@query(ASSETS + f" SELECT path AS subject_id, CASE WHEN code IN {UNVERIFIED} THEN 'unverified' ELSE 'error' END AS kind, code, path AS location FROM a WHERE code IS NOT NULL")
def int1_verify_assets(t: Tables) -> DataFrame:
    return integrity.verify_assets(assets(t), inventory(t))


@query(ASSETS + """ SELECT path AS asset_id, CASE WHEN code IS NULL THEN sha256 END AS value, code IS NULL AS reusable, CASE WHEN code IS NULL THEN '' WHEN code = 'uri-asset-unverified' THEN 'ASSET_REMOTE'
  WHEN code IN ('missing-local-asset', 'asset-kind-mismatch', 'file-size-mismatch', 'checksum-mismatch') THEN 'ASSET_MISMATCH' WHEN code = 'directory-content-unverified' THEN 'ASSET_UNVERIFIED' ELSE 'ASSET_WEAK' END AS reasons FROM a""")
def int6_asset_identities(t: Tables) -> DataFrame:
    out = integrity.asset_identities(assets(t), inventory(t))
    return out.select("asset_id", "identity.value", "identity.reusable", F.array_join("identity.reasons", ",").alias("reasons"))


@query("""WITH m AS (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS digest FROM orders),
d AS (SELECT o_custkey, '[' || string_agg('{"path":"' || path || '","kind":"file","digest":"' || digest || '"}', ',' ORDER BY path) || ']' AS text, count(*) = count(digest) AS whole FROM m GROUP BY 1),
i AS (SELECT o_custkey, text, CASE WHEN o_custkey % 7 = 0 OR o_custkey % 11 = 0 THEN 'DIRECTORY_MANIFEST_MISSING' WHEN o_custkey % 5 = 0 THEN 'DIRECTORY_MANIFEST_MISMATCH' WHEN o_custkey % 6 = 1 OR NOT whole THEN 'DIRECTORY_CONTENT_UNVERIFIED' END AS reason FROM d)
SELECT CAST(o_custkey AS VARCHAR) AS asset_id, CASE WHEN reason IS NULL THEN sha256('runloom.directory.v1' || chr(0) || text) END AS value, coalesce(reason, '') AS reasons FROM i""")
def int6_directory_identities(t: Tables) -> DataFrame:
    """A directory per customer with orders; members are the orders."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    members_ = t.orders.select(c.alias("dir_id"), F.lpad(k.cast("string"), 9, "0").alias("path"), F.lit("file").alias("kind"), F.when(k % 40 == 0, "md5").otherwise("SHA256").alias("algorithm"), F.sha2(k.cast("string"), 256).alias("digest"))
    dirs = t.orders.select("o_custkey").distinct()
    manifests = dirs.where("o_custkey % 7 > 0").select(c.alias("asset_id"), c.cast("string").cast("binary").alias("content"))
    refs = dirs.select(c.alias("asset_id"), F.when(c % 11 == 0, None).when(c % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(c.cast("string"), 256)).alias("manifest_digest"))
    found = dirs.where("o_custkey % 6 = 1").select(c.cast("string").alias("subject_id"), F.lit("error").alias("kind"), F.lit("member-missing").alias("code"), F.lit("x").alias("location"))
    out = integrity.directory_identities(refs, manifests, members_, found)
    return out.select("asset_id", "identity.value", F.array_join("identity.reasons", ",").alias("reasons"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'removed' WHEN o_orderkey % 10 = 2 THEN 'added' ELSE 'changed' END AS change FROM orders
WHERE o_orderkey % 10 IN (1, 2) OR (o_orderkey % 3 = 0 AND o_orderstatus <> 'P')""")
def int5_inventory_diff(t: Tables) -> DataFrame:
    before = t.orders.where("o_orderkey % 10 <> 2").select("o_orderkey", "o_orderstatus", "o_custkey")
    after = t.orders.where("o_orderkey % 10 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    return integrity.inventory_diff(before, after, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


@query(RECONCILED + """, c AS (SELECT dir_id AS s, kind, code, path FROM i UNION ALL SELECT dir_id, 'error', 'too-many-members', 'n' FROM d GROUP BY dir_id HAVING count(*) > 2)
SELECT d.dir_id AS subject_id, count(code) FILTER (kind = 'error') AS n_error, count(code) FILTER (kind = 'unverified') AS n_unverified, count(code) FILTER (kind = 'error') = 0 AS is_valid, count(code) = 0 AS is_fully_verified
FROM (SELECT DISTINCT dir_id FROM d) d LEFT JOIN c ON c.s = d.dir_id GROUP BY d.dir_id""")
def udx1_apply_checks(t: Tables) -> DataFrame:
    m = members(t)

    def crowded(df: DataFrame) -> DataFrame:
        n = df.groupBy("dir_id").count().where("count > 2")
        return n.select(F.col("dir_id").alias("subject_id"), F.lit("error").alias("kind"), F.lit("too-many-members").alias("code"), F.lit("n").alias("location"))

    return issues.verified_by(m, "dir_id", {"reconcile": lambda df: integrity.reconcile_directory(df, inventory(t)), "crowded": crowded})
