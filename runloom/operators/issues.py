"""The common output of all checks: one row per issue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.sources.shared import checkpointed

ERROR, UNVERIFIED = "error", "unverified"
SCHEMA = "subject_id string, kind string, code string, location string"


def issue(when: Column, code: str, location: Column | str, kind: str = ERROR) -> Column:
    """An issue struct if ``when`` is true, else null."""
    location = F.lit(location) if isinstance(location, str) else location
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), location.cast("string").alias("location")))


def all_issues(df: DataFrame, subject: Column, *found: Column) -> DataFrame:
    """Every issue of every row."""
    rows = df.select(subject.cast("string").alias("subject_id"), F.explode(F.array_compact(F.array(*found))).alias("i"))
    return rows.select("subject_id", "i.kind", "i.code", "i.location")


def first_issue(df: DataFrame, subject: Column, *found: Column) -> DataFrame:
    """The first issue of every row that has one."""
    rows = df.select(subject.cast("string").alias("subject_id"), F.coalesce(*found).alias("i")).where("i IS NOT NULL")
    return rows.select("subject_id", "i.kind", "i.code", "i.location")


def rollup(issues: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    """Per subject ``n_error, n_unverified, is_valid, is_fully_verified``; subjects without issues count."""
    n = issues.groupBy("subject_id").agg(F.count_if(F.col("kind") == ERROR).alias("n_error"), F.count_if(F.col("kind") == UNVERIFIED).alias("n_unverified"))
    all_ = subjects.select(F.col(subject).cast("string").alias("subject_id")).distinct().join(n, "subject_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = all_.select("subject_id", zero("n_error"), zero("n_unverified"))
    return out.withColumn("is_valid", F.col("n_error") == 0).withColumn("is_fully_verified", (F.col("n_error") == 0) & (F.col("n_unverified") == 0))


def apply_checks(df: DataFrame, subject: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Issues of user-supplied checks, each a function from the table to an issue table.

    Each check is run to its end and written to the shared checkpoint folder. One that can't be planned, fails
    while it runs or returns another shape gives one unverified issue with a safe code; its message is not
    reported.
    """
    out = None
    for name, check in checks.items():
        try:
            got = checkpointed(check(df).select(*[F.col(c.split()[0]).cast("string") for c in SCHEMA.split(", ")]))
        except Exception:  # noqa: BLE001 - code of the user's, whatever it raises
            got = df.select(F.lit(None).cast("string").alias("subject_id"), F.lit(UNVERIFIED).alias("kind"), F.lit("CHECK_FAILED").alias("code"), F.lit(name).alias("location")).limit(1)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return out


def verified_by(df: DataFrame, subject: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Rollup of :func:`apply_checks`; a failed check leaves every subject unverified."""
    found = apply_checks(df, subject, checks)
    failed = found.where("subject_id IS NULL").agg((F.count("*") > 0).alias("failed"))
    out = rollup(found.where("subject_id IS NOT NULL"), df, subject).crossJoin(failed)
    return out.withColumn("is_fully_verified", F.col("is_fully_verified") & ~F.col("failed")).drop("failed")
