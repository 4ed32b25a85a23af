"""Reuse decisions: whether an earlier result stands in for a task, and the first reason if not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.exprs import is_digest
from runloom.operators.issues import all_issues, issue

# Reject codes in the order in which they are decided.
TASK_CODES = ("POLICY_OR_RECIPE", "EXECUTION_WEAK", "RECIPE_MISMATCH", "EXECUTION_MISMATCH", "INPUT_MISMATCH", "INPUT_PORTS", "UNCOMMITTED", "BINDING", "OUTPUT_PORTS")
PORT_CODES = ("OUTPUT_CONTRACT", "OUTPUT_COUNT", "COMMIT_OUTPUTS")
OUTPUT_CODES = (
    "DUPLICATE_RECORD", "SCHEMA", "MANIFEST_DIGEST", "MANIFEST_SCHEMA", "DECODER_MISSING", "RECORD_SCHEMA", "PRODUCT_PRODUCER", "PROFILE",
    "PRODUCT_LINEAGE", "PRODUCT_PRODUCTION", "ASSETS_MISSING", "ASSET_UNVERIFIED", "RECORD_ASSETS_OR_PROFILE", "RECORD_ID", "RECORD_UNVERIFIED",
    "RESULT_IDENTITY", "RECORD_INVALID",
)


def can_publish(policy: Column, reusable: Column) -> Column:
    """Automatic policy and a strong recipe."""
    return F.coalesce((policy == "auto") & reusable, F.lit(False))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that holds (a null rule doesn't), with its prefix; null if none does."""
    return F.coalesce(*[F.when(rule, F.lit(f"CACHE_{code}")) for code, rule in rules])


def task_reason() -> Column:
    """Task-level verdict over a row that holds task and candidate side by side.

    Columns: policy, recipe, recipe_reusable, execution, execution_reusable, inputs, task_ports, c_recipe,
    c_execution, c_inputs, c_ports, committed, operation, b_operation, b_outputs, t_outputs, c_outputs,
    m_outputs (port arrays, sorted).
    """
    c = F.col
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    return first_reason(
        [
            ("POLICY_OR_RECIPE", ~can_publish(c("policy"), c("recipe_reusable"))),
            ("EXECUTION_WEAK", ~F.coalesce(c("execution_reusable"), F.lit(False))),
            ("RECIPE_MISMATCH", differ("c_recipe", "recipe")),
            ("EXECUTION_MISMATCH", differ("c_execution", "execution")),
            ("INPUT_MISMATCH", c("inputs").isNull() | differ("inputs", "c_inputs")),
            ("INPUT_PORTS", differ("task_ports", "c_ports")),
            ("UNCOMMITTED", ~F.coalesce(c("committed"), F.lit(False))),
            ("BINDING", differ("operation", "b_operation")),
            ("OUTPUT_PORTS", differ("c_outputs", "b_outputs") | differ("t_outputs", "b_outputs") | differ("m_outputs", "b_outputs")),
        ]
    )


def decide(candidates: DataFrame, ports: DataFrame | None = None, outputs: DataFrame | None = None, key: str = "candidate_id") -> DataFrame:
    """``(key, accepted, reason)`` of every candidate.

    ``candidates`` carry the columns of :func:`task_reason`. ``ports``: key, port, and booleans contract_ok,
    count_ok, commit_ok. ``outputs``: key, port, ord, and a boolean column per output code in lower case,
    true where that rule rejects (missing columns reject nothing). The verdict is the first in task, then
    port order, then output order: one minimum per candidate, partially aggregated. :func:`output_rules` works the
    output columns out from the facts.
    """
    own = candidates.select(key, F.struct(F.lit("").alias("port"), F.lit(-1).alias("ord"), F.lit(0).alias("rule"), task_reason().alias("reason")).alias("v")).where("v.reason IS NOT NULL")
    verdicts = own.select(key, F.lit(0).alias("level"), "v")
    if ports is not None:
        bad = lambda c: ~F.coalesce(F.col(c), F.lit(False))
        reason = first_reason(list(zip(PORT_CODES, (bad("contract_ok"), bad("count_ok"), bad("commit_ok")))))
        per = ports.select(key, F.lit(1).alias("level"), F.struct("port", F.lit(-1).alias("ord"), F.lit(0).alias("rule"), reason.alias("reason")).alias("v"))
        verdicts = verdicts.unionByName(per.where("v.reason IS NOT NULL"))
    if outputs is not None:
        known = [c for c in OUTPUT_CODES if c.lower() in outputs.columns]
        rule = F.coalesce(*[F.when(F.col(c.lower()), F.lit(OUTPUT_CODES.index(c) + 1)) for c in known], F.lit(0))
        reason = first_reason([(c, F.col(c.lower())) for c in known])
        per = outputs.select(key, F.lit(1).alias("level"), F.struct("port", F.col("ord").cast("int").alias("ord"), rule.alias("rule"), reason.alias("reason")).alias("v"))
        verdicts = verdicts.unionByName(per.where("v.reason IS NOT NULL"))
    first = verdicts.groupBy(key).agg(F.min(F.struct("level", "v")).alias("f")).select(key, F.col("f.v.reason").alias("reason"))
    return candidates.select(key).distinct().join(first, key, "left").select(key, F.col("reason").isNull().alias("accepted"), "reason")


def output_rules(outputs: DataFrame, key: str = "candidate_id") -> DataFrame:
    """``outputs`` with a boolean column per output code, as :func:`decide` takes them, worked out from the facts.

    A row is an output of a candidate: key, port, ord, ``ref`` (record_id, schema_id, schema_version,
    manifest_digest, semantic_digest), ``want`` (schema_id, schema_version, profile) of the port, ``manifest``
    (bytes), decoder_missing and record_invalid of :func:`decide_records`, ``record`` (schema_id,
    schema_version, record_id, profile, producer, fingerprint, output_port, execution, lineage and asset_ids
    arrays, is_product) as decoded, ``task`` (producer, fingerprint, execution, lineage) as it would run now,
    ``assets`` (array of asset_id, same, strong) as supplied, fully_verified (of the port's validator) and
    ``identity``, the recomputed result identity or null.
    """
    c, ref, want, record, task = F.col, F.col("ref"), F.col("want"), F.col("record"), F.col("task")
    differ = lambda a, b: ~a.eqNullSafe(b)
    product = F.coalesce(record["is_product"], F.lit(False))
    text = c("manifest").cast("string")
    v = F.try_parse_json(text)
    told = F.try_variant_get(v, "$.schema_id", "string")
    version = F.try_variant_get(v, "$.schema_version", "int")
    supplied = F.array_sort(F.transform("assets", lambda a: a["asset_id"]))
    nth = F.row_number().over(Window.partitionBy(key, "ref.record_id").orderBy("port", "ord"))
    return outputs.withColumns(
        {
            "duplicate_record": nth > 1,
            "schema": differ(ref["schema_id"], want["schema_id"]) | differ(ref["schema_version"], want["schema_version"]),
            "manifest_digest": ~F.coalesce(is_digest(ref["manifest_digest"]) & (F.sha2("manifest", 256) == ref["manifest_digest"]), F.lit(False)),
            "manifest_schema": differ(told, ref["schema_id"]) | differ(version, ref["schema_version"]),
            "record_schema": differ(record["schema_id"], ref["schema_id"]) | differ(record["schema_version"], ref["schema_version"]),
            "product_producer": product & (differ(record["record_id"], ref["record_id"]) | differ(record["producer"], task["producer"])),
            "profile": product & want["profile"].isNotNull() & differ(record["profile"], want["profile"]),
            "product_lineage": product & differ(record["lineage"], task["lineage"]),
            "product_production": product & (differ(record["fingerprint"], task["fingerprint"]) | differ(record["output_port"], c("port")) | differ(record["execution"], task["execution"])),
            "assets_missing": product & differ(supplied, F.array_sort(record["asset_ids"])),
            "asset_unverified": product & F.exists("assets", lambda a: ~F.coalesce(a["same"] & a["strong"], F.lit(False))),
            "record_assets_or_profile": ~product & ((F.size("assets") > 0) | want["profile"].isNotNull()),
            "record_id": ~product & differ(record["record_id"], ref["record_id"]),
            "record_unverified": ~F.coalesce(c("fully_verified"), F.lit(False)),
            "result_identity": ~F.coalesce(is_digest(c("identity")) & (c("identity") == ref["semantic_digest"]), F.lit(False)),
        }
    )


def decide_records(outputs: DataFrame, decoders: dict, content: str = "content", schema: str = "schema_id") -> DataFrame:
    """``outputs`` decoded by the user's functions, one per schema id, from bytes to a JSON text or None.

    Adds ``decoded`` and the reject flags ``decoder_missing`` (no function for the schema) and
    ``record_invalid`` (it raised or gave nothing). Functions run on Arrow batches in the tasks.
    """
    known = dict(decoders)

    @F.pandas_udf(T.StringType())
    def decode(schemas: pd.Series, contents: pd.Series) -> pd.Series:
        def one(s, b):
            if s not in known or b is None:
                return None
            try:
                return known[s](bytes(b))
            except Exception:  # noqa: BLE001 - a user's decoder may raise anything
                return None

        return pd.Series([one(s, b) for s, b in zip(schemas, contents)], dtype=object)

    missing = ~F.coalesce(F.col(schema).isin(*known), F.lit(False)) if known else F.lit(True)
    rows = outputs.withColumn("decoded", decode(F.col(schema), F.col(content).cast("binary")))
    return rows.withColumn("decoder_missing", missing).withColumn("record_invalid", ~missing & F.col("decoded").isNull())


def select_candidate(candidates: DataFrame, by: list[str], key: str = "candidate_id") -> DataFrame:
    """The first accepted candidate of each task: own-scope attempts newest first, then receipts by path.

    ``candidates``: by, key, own_scope, sequence, path, accepted. Repeats of a candidate count once.
    """
    once = candidates.where("accepted").groupBy(*by, key).agg(F.max("own_scope").alias("own_scope"), F.max("sequence").alias("sequence"), F.min("path").alias("path"))
    rank = F.struct((~F.col("own_scope")).alias("foreign"), F.when(F.col("own_scope"), -F.col("sequence")).alias("newest"), "path", key)
    return once.groupBy(*by).agg(F.min_by(key, rank).alias(key))


def damage_attribution(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per task whether a broken candidate of its own recipe exists, which forbids an unsafe restart.

    ``candidates``: by, broken, started_recipe, recipe, restartable.
    """
    damaged = F.bool_or(F.coalesce(F.col("broken") & (F.col("started_recipe") == F.col("recipe")), F.lit(False)))
    out = candidates.groupBy(*by).agg(damaged.alias("damaged"), F.bool_and("restartable").alias("restartable"))
    return out.withColumn("forbidden", F.col("damaged") & ~F.col("restartable"))


def check_candidates(candidates: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates of another version, with weak identities, or with input ports that aren't sorted and unique.

    Columns: schema_version, fingerprint, execution_identity, ports array, digests array, receipt_digest.
    """
    ports, ok = F.col("ports"), lambda c: F.coalesce(is_digest(F.col(c)), F.lit(False))
    return all_issues(
        candidates,
        F.col(key),
        issue(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "CACHE_SCHEMA_VERSION", "schema_version"),
        issue(~(ok("fingerprint") & ok("execution_identity")), "CACHE_IDENTITY", "fingerprint"),
        issue(F.coalesce(F.array_sort(F.array_distinct(ports)) != ports, F.lit(True)) | F.exists("digests", lambda d: ~F.coalesce(is_digest(d), F.lit(False))), "CACHE_INPUT_METADATA", "ports"),
        issue(F.col("receipt_digest").isNotNull() & ~ok("receipt_digest"), "CACHE_RECEIPT", "receipt_digest"),
    )


def reuse_stats(resolutions: DataFrame, run: str = "run_id") -> DataFrame:
    """Tasks executed and reused per run."""
    return resolutions.groupBy(run, "disposition").agg(F.count("*").alias("n_tasks"))
