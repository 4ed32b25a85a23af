"""Column expressions that the table jobs share: grammars, paths, dates, secrets, tri-state values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a key as secret, once it is lower-cased and stripped of punctuation.
SECRET_WORDS = (
    "password", "passwd", "token", "accesstoken", "refreshtoken", "apikey", "secret", "clientsecret",
    "privatekey", "authorization", "cookie", "credentials", "username", "authentication",
)
# Query keys of signed or credential-bearing addresses.
SIGNED_QUERY_KEYS = (
    "auth", "credential", "signature", "sig", "x-amz-signature", "x-amz-credential", "x-amz-security-token",
    "x-goog-signature", "x-goog-credential", "x-amz-algorithm", "x-amz-date", "x-amz-expires",
)
# Private-key header, address with user information, address scheme.
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
URL_AUTH = r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]*@"
URL_SCHEME = r"\A[a-zA-Z][a-zA-Z0-9+.-]*://"
# Short names of platforms and providers, and of stages in old option files.
ALIASES = {
    "platform": {"S1": "Sentinel-1", "S1A": "Sentinel-1A", "S1B": "Sentinel-1B", "S1C": "Sentinel-1C", "S1D": "Sentinel-1D"},
    "provider": {"copernicus": "cdse"},
    "stage": {"config": "prepare", "post": "postprocess"},
}


def is_identifier(c: Column) -> Column:
    """Non-empty, without white space, control and format characters."""
    return c.rlike(r"\A[^\s\p{Z}\p{C}]+\z")


def is_digest(c: Column) -> Column:
    """64 lowercase hexadecimal digits and nothing else."""
    return c.rlike(r"\A[0-9a-f]{64}\z")


def is_namespaced(c: Column) -> Column:
    """Exactly one colon between two identifiers."""
    parts = F.split(c, ":")
    return (F.size(parts) == 2) & is_identifier(F.try_element_at(parts, F.lit(1))) & is_identifier(F.try_element_at(parts, F.lit(2)))


def is_secret_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "").rlike("|".join(SECRET_WORDS))


def query_keys(c: Column) -> Column:
    """Decoded keys of an address's query; keys without a value count."""
    query = F.regexp_extract(c, r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "[&;]"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, r"\A([^=]*)", 1)), p))


def has_secret_value(c: Column, extra_keys: tuple[str, ...] = SIGNED_QUERY_KEYS) -> Column:
    """A private key, user information in an address, or a secret or signing key in its query."""
    keyed = c.rlike(URL_SCHEME) & F.exists(query_keys(c), lambda k: is_secret_key(k) | F.lower(k).isin(*extra_keys))
    return F.coalesce(c.rlike(PEM) | c.rlike(URL_AUTH) | keyed, F.lit(False))


def path_ok(c: Column) -> Column:
    """Non-empty; no control character, backslash, tilde, variable, leading // or scheme."""
    return (c != "") & ~c.rlike(r"[\x00-\x1F\x7F-\x9F\\~]|\$(?:[A-Za-z_]|\{)") & ~c.startswith("//") & ~c.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")


def lexical_abspath(c: Column, base: Column | str) -> Column:
    """``c`` under ``base`` with empty, . and .. parts folded, without a look at any disk."""
    base = F.lit(base) if isinstance(base, str) else base
    full = F.when(c.startswith("/"), c).otherwise(F.concat(base, F.lit("/"), c))
    folded = F.aggregate(
        F.split(full, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when((part == "") | (part == "."), done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def ancestors(c: Column) -> Column:
    """Every proper prefix of a slash-separated path, shortest first."""
    parts = F.split(c, "/")
    none = F.array().cast("array<string>")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(none)


def member_path_ok(c: Column) -> Column:
    """Relative and trimmed; no backslash, tilde, variable or control character; no empty, . or .. part."""
    shape = (c != "") & (F.trim(c) == c) & ~c.rlike(r"[\x00-\x1F\x7F-\x9F\\~]|\$(?:[A-Za-z_]|\{)") & ~c.startswith("/")
    return shape & F.forall(F.split(c, "/"), lambda p: ~p.isin("", ".", ".."))


def iso_date(c: Column) -> Column:
    """ISO date of ``YYYYMMDD`` or ``YYYY-MM-DD``; null unless that day exists."""
    dashed = F.when(c.rlike(r"\A[0-9]{8}\z"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c)
    day = F.try_to_date(dashed, "yyyy-MM-dd")
    return F.when(day.isNotNull(), dashed)


def canonical_alias(c: Column, domain: str) -> Column:
    """The full name of an alias; other values stay."""
    pairs = [F.lit(x) for kv in ALIASES[domain].items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def label_ok(c: Column) -> Column:
    """One line of at most 128 characters that isn't blank."""
    return (F.trim(c) != "") & (F.length(c) <= 128) & ~c.rlike(r"[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]")


def semantic_ok(status: Column, value: Column, reason: Column) -> Column:
    """A known value is there and needs no reason; unknown and not applicable ones need one instead."""
    return F.when(status == "known", value.isNotNull()).when(status.isin("unknown", "not_applicable"), value.isNull() & F.coalesce(is_identifier(reason), F.lit(False))).otherwise(False)


def nodata_ok(kind: Column, value: Column, mask: Column) -> Column:
    """Exclusive fields: a finite value, a mask layer, or neither, as the kind asks."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return (
        F.when(kind == "finite_value", finite & mask.isNull())
        .when(kind == "mask", value.isNull() & F.coalesce(is_identifier(mask), F.lit(False)))
        .when(kind.isin("none", "nan"), value.isNull() & mask.isNull())
        .otherwise(False)
    )


def reason_codes(reasons: Column) -> Column:
    """Reasons sorted, distinct and well formed."""
    return F.sort_array(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull() & r.rlike(r"\A[A-Z][A-Z0-9_]*\z"))))


def fingerprint_struct(value: Column, reasons: Column) -> Column:
    """Digest xor reasons: reasons are sorted, distinct and well formed, and a value with reasons is none."""
    codes = reason_codes(reasons)
    strong = (F.size(codes) == 0) & F.coalesce(is_digest(value), F.lit(False))
    return F.struct(F.when(strong, value).alias("value"), strong.alias("reusable"), codes.alias("reasons"))


def with_fingerprint(df: DataFrame, name: str, value: Column, reasons: Column) -> DataFrame:
    """``df`` with :func:`fingerprint_struct` as ``name``, worked out step by step: each part once, the value only where there is no reason."""
    steps = df.withColumn("fp_codes", reason_codes(reasons))
    steps = steps.withColumn("fp_value", F.when(F.size("fp_codes") == 0, value))
    steps = steps.withColumn("fp_strong", F.coalesce(is_digest(F.col("fp_value")), F.lit(False)))
    whole = F.struct(F.when(F.col("fp_strong"), F.col("fp_value")).alias("value"), F.col("fp_strong").alias("reusable"), F.col("fp_codes").alias("reasons"))
    return steps.withColumn(name, whole).drop("fp_codes", "fp_value", "fp_strong")


def location_ok(kind: Column, value: Column, anchor: Column) -> Column:
    """Relative locations need an absolute anchor, absolute ones none; remote ones carry no credentials."""
    relative = member_path_ok(value) & F.coalesce(anchor.startswith("/") & path_ok(anchor), F.lit(False))
    absolute = value.startswith("/") & path_ok(value) & anchor.isNull()
    remote = value.rlike(URL_SCHEME) & ~has_secret_value(value) & anchor.isNull()
    return F.coalesce(F.when(kind == "manifest_relative", relative).when(kind == "absolute_local", absolute).when(kind == "remote_reference", remote), F.lit(False))


def path_key(c: Column) -> Column:
    """Partition key of an id."""
    return F.sha2(c, 256)
