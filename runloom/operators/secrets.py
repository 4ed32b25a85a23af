"""Secret scans over JSON columns and over text lines; findings carry a code, never a payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.exprs import has_secret_value, is_secret_key
from runloom.operators.issues import ERROR



def scan_nested(df: DataFrame, subject: str, json_col: str) -> DataFrame:
    """One issue per row whose JSON holds a secret key or value at any depth.

    Keys and strings are taken from the text itself and their escapes are decoded; ``authentication_required``
    with a boolean or null is the one exempt key. Rows that aren't JSON are scanned alike, null rows have no
    issue.
    """
    text = F.col(json_col)
    key = r'"((?:[^"\\]|\\.)*)"\s*:'
    exempt = r'"authentication_required"\s*:\s*(?:true|false|null)'
    stripped = F.regexp_replace(text, exempt, '"_":0')
    keys = F.regexp_extract_all(stripped, F.lit(key), F.lit(1))
    strings = F.regexp_extract_all(stripped, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    plain = lambda s: F.when(s.contains("\\"), F.coalesce(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>")[0], s)).otherwise(s)
    bad_key, bad_value = F.exists(F.transform(keys, plain), is_secret_key), F.exists(F.transform(strings, plain), lambda s: has_secret_value(s))
    rows = df.select(F.col(subject).cast("string").alias("subject_id"), F.coalesce(bad_key, F.lit(False)).alias("k"), F.coalesce(bad_value, F.lit(False)).alias("v"))
    code = F.when(F.col("k"), "secret-key").otherwise("secret-value")
    return rows.where("k OR v").select("subject_id", F.lit(ERROR).alias("kind"), code.alias("code"), F.lit(json_col).alias("location"))


def scan_lines(df: DataFrame, subject: str, text_col: str, anchored: bool = True) -> DataFrame:
    """One issue per line that holds a secret value, or ``key: value`` / ``key = value`` with a secret key.

    ``anchored`` looks for the key at the start of a line only, otherwise anywhere in it. The location
    is the number of the line, from 1.
    """
    lines = df.select(F.col(subject).cast("string").alias("subject_id"), F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("n", "line"))
    line = F.col("line")
    lines = lines.where(line.contains(":") | line.contains("=") | line.contains("-----BEGIN"))  # nothing else can match below
    start = r"\A\s*" if anchored else ""
    pairs = F.regexp_extract_all("line", F.lit(start + r"[\"']?([A-Za-z0-9_.-]+)[\"']?\s*[:=]\s*\S"), F.lit(1))
    urls = F.regexp_extract_all("line", F.lit(r"([A-Za-z][A-Za-z0-9+.-]*://\S+)"), F.lit(1))
    found = F.when(F.exists(pairs, is_secret_key), "secret-key").when(has_secret_value(F.col("line")) | F.exists(urls, lambda u: has_secret_value(u)), "secret-value")
    rows = lines.select("subject_id", found.alias("code"), (F.col("n") + 1).cast("string").alias("location")).where("code IS NOT NULL")
    return rows.select("subject_id", F.lit(ERROR).alias("kind"), "code", "location")
