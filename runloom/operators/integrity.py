"""Declared assets and directory members against observed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.digests import PREFIX, directory_digest
from runloom.functions.exprs import ancestors, fingerprint_struct, is_digest
from runloom.operators.issues import ERROR, UNVERIFIED, all_issues, first_issue, issue


def verify_assets(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """The first issue of each asset, in decision order.

    ``assets``: asset_id, asset_kind, location_kind, path, size_bytes, algorithm, digest. ``inventory``:
    path, kind, size_bytes, sha256 (null: unreadable), unique by path. One left join; skew on a path
    doesn't occur as observed paths are unique.
    """
    seen = inventory.select("path", F.col("kind").alias("o_kind"), F.col("size_bytes").alias("o_size"), F.col("sha256").alias("o_digest"), F.lit(True).alias("o"))
    rows = assets.join(seen, "path", "left")
    at = F.col("path")
    local = F.col("o").isNotNull()
    file = F.col("asset_kind") == "file"
    return first_issue(
        rows,
        F.col("asset_id"),
        issue(F.col("location_kind") == "remote_reference", "uri-asset-unverified", at, UNVERIFIED),
        issue(~local, "missing-local-asset", at),
        issue(local & F.col("o_kind").isNull(), "asset-io-unverified", at, UNVERIFIED),
        issue(F.col("o_kind") != F.col("asset_kind"), "asset-kind-mismatch", at),
        issue(~file, "directory-content-unverified", at, UNVERIFIED),
        issue(F.col("size_bytes") != F.col("o_size"), "file-size-mismatch", at),
        issue(F.col("digest").isNull(), "checksum-not-declared", at, UNVERIFIED),
        issue(F.lower("algorithm") != "sha256", "checksum-algorithm-unverified", at, UNVERIFIED),
        issue(~is_digest(F.lower("digest")), "invalid-sha256-checksum", at),
        issue(F.col("o_digest").isNull(), "asset-io-unverified", at, UNVERIFIED),
        issue(F.lower("digest") != F.col("o_digest"), "checksum-mismatch", at),
    )


def reconcile_directory(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """All issues of declared members against observed files, by directory.

    ``members``: dir_id, path, member_kind, size_bytes, algorithm, digest. ``inventory``: dir_id, path,
    kind, size_bytes, sha256. One full outer join on (dir_id, path): a directory of any size is spread
    over the paths in it.
    """
    m = members.select("dir_id", "path", F.col("member_kind").alias("m_kind"), F.col("size_bytes").alias("m_size"), F.col("algorithm").alias("m_alg"), F.col("digest").alias("m_digest"), F.lit(True).alias("m"))
    o = inventory.select("dir_id", "path", F.col("kind").alias("o_kind"), F.col("size_bytes").alias("o_size"), F.col("sha256").alias("o_digest"), F.lit(True).alias("o"))
    rows = m.join(o, ["dir_id", "path"], "full_outer")
    both = F.col("m").isNotNull() & F.col("o").isNotNull()
    same = both & (F.col("m_kind") == F.col("o_kind"))
    file = same & (F.col("m_kind") == "file")
    digest = file & F.col("m_digest").isNotNull() & (F.lower("m_alg") == "sha256")
    valid = is_digest(F.lower("m_digest"))
    at = F.col("path")
    return all_issues(
        rows,
        F.col("dir_id"),
        issue(F.col("o").isNull(), "member-missing", at),
        issue(F.col("m").isNull(), "member-unexpected", at),
        issue(both & (F.col("m_kind") != F.col("o_kind")), "member-kind-mismatch", at),
        issue(digest & ~valid, "member-invalid-sha256", at),
        issue(file & (F.col("m_size") != F.col("o_size")) & ~F.coalesce(digest & ~valid, F.lit(False)), "member-size-mismatch", at),
        issue(digest & valid & (F.lower("m_digest") != F.col("o_digest")), "member-integrity-mismatch", at),
        issue(file & (F.col("m_digest").isNull() | (F.lower("m_alg") != "sha256") | F.col("m_alg").isNull()), "member-integrity-unverified", at, UNVERIFIED),
    )


def suppress_uncertain(issues: DataFrame, uncertain: DataFrame, opaque: DataFrame) -> DataFrame:
    """Issues without those below an opaque entry, nor "missing" ones below an unreadable prefix.

    ``uncertain``: dir_id, prefix. ``opaque``: dir_id, path. A path is exploded into itself and its
    ancestors, so both rules are equi-joins.
    """
    key = ["subject_id", "kind", "code", "location"]
    prefixes = F.concat(ancestors(F.col("location")), F.array("location"), F.array(F.lit("")))
    up = issues.select(*key, F.explode(prefixes).alias("prefix"))
    hidden = up.where("prefix <> location").join(opaque.select(F.col("dir_id").cast("string").alias("subject_id"), F.col("path").alias("prefix")), ["subject_id", "prefix"], "left_semi").select(*key)
    unread = up.where("code = 'member-missing'").join(uncertain.select(F.col("dir_id").cast("string").alias("subject_id"), "prefix"), ["subject_id", "prefix"], "left_semi").select(*key)
    return issues.join(hidden.unionByName(unread).distinct(), key, "left_anti")


#: Severity classes of directory issues at one path, in order.
_CLASSES = ("member-missing", "member-unexpected", "member-kind-mismatch", "member-invalid-sha256", "member-size-mismatch", "member-integrity-mismatch", "member-integrity-unverified")


def order_rank(code: Column, location: Column) -> list[Column]:
    """Sort keys of directory issues: root and manifest first, then path, then severity class."""
    place = F.when(code.startswith("root") | code.startswith("manifest") | code.startswith("remote"), 0).otherwise(1)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in _CLASSES]), code), F.lit(0))
    return [place, location, rank, code]


def order_directory_issues(issues: DataFrame) -> DataFrame:
    """Issues with ``issue_rank``, their place inside the subject."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject_id").orderBy(*order_rank(F.col("code"), F.col("location")))
    return issues.withColumn("issue_rank", F.row_number().over(w).cast("long"))


def inventory_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values changed, appeared or vanished between two observations, with ``change``."""
    a = before.select(*keys, F.struct(*values).alias("was"))
    b = after.select(*keys, F.struct(*values).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def asset_identities(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(asset_id, identity)``: the observed digest, or the first reason why there is none."""
    codes = verify_assets(assets, inventory).select(F.col("subject_id").alias("asset_id"), "code")
    seen = inventory.select("path", F.col("sha256").alias("o_digest"))
    rows = assets.withColumn("asset_id", F.col("asset_id").cast("string")).join(codes, "asset_id", "left").join(seen, "path", "left")
    reason = (
        F.when(F.col("code") == "uri-asset-unverified", "ASSET_REMOTE")
        .when(F.col("code").isin("missing-local-asset", "asset-kind-mismatch", "file-size-mismatch", "checksum-mismatch"), "ASSET_MISMATCH")
        .when(F.col("code").isin("checksum-not-declared", "checksum-algorithm-unverified", "invalid-sha256-checksum"), "ASSET_WEAK")
        .when(F.col("code").isNotNull(), "ASSET_UNVERIFIED")
    )
    reasons = F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason))
    return rows.select("asset_id", fingerprint_struct(F.col("o_digest"), reasons).alias("identity"))


def directory_identities(assets: DataFrame, manifests: DataFrame, members: DataFrame, issues: DataFrame, domain: str = f"{PREFIX}.directory.v1") -> DataFrame:
    """``(asset_id, identity)`` of directory assets: the digest over their members, or the first reason for none.

    ``assets``: asset_id, manifest_digest as referred to; ``manifests``: asset_id, content (bytes); ``members``:
    dir_id, path, kind, algorithm, digest as the manifest lists them; ``issues`` of
    :func:`reconcile_directory`, which leave a directory unverified, as does a member without a SHA-256.
    """
    at = lambda df, name: df.withColumn("asset_id", F.col(name).cast("string"))
    listed = members.withColumn("digest", F.when((F.col("kind") != "file") | (F.lower("algorithm") == "sha256"), F.col("digest")))
    made = at(directory_digest(listed, "dir_id", domain=domain), "dir_id").select("asset_id", F.col("identity").alias("made"))
    bad = issues.select(F.col("subject_id").alias("asset_id"), F.lit(True).alias("bad")).distinct()
    rows = at(assets, "asset_id").join(at(manifests, "asset_id").select("asset_id", F.sha2("content", 256).alias("got")), "asset_id", "left").join(made, "asset_id", "left").join(bad, "asset_id", "left")
    reason = (
        F.when(F.col("got").isNull() | ~F.coalesce(is_digest(F.col("manifest_digest")), F.lit(False)), "DIRECTORY_MANIFEST_MISSING")
        .when(F.col("got") != F.col("manifest_digest"), "DIRECTORY_MANIFEST_MISMATCH")
        .when(F.col("bad") | ~F.coalesce(F.col("made.reusable"), F.lit(False)), "DIRECTORY_CONTENT_UNVERIFIED")
    )
    reasons = F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason))
    return rows.select("asset_id", fingerprint_struct(F.col("made.value"), reasons).alias("identity"))


__all__ = ["ERROR", "UNVERIFIED", "asset_identities", "directory_identities", "inventory_diff", "order_directory_issues", "reconcile_directory", "suppress_uncertain", "verify_assets"]
