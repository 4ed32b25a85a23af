"""Reuse decisions (CCH): a candidate per event, a task per user and event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import reuse as R
from runloom.plans.registry import Tables, query

BY = ["user_id", "event_type"]


def candidates(t: Tables) -> DataFrame:
    i = F.col("event_id")
    h = lambda c: F.sha2(c, 256)
    good, ports = F.array(F.lit("out")), F.array(F.lit("in"))
    return t.events.select(
        i.alias("candidate_id"), *BY,
        F.when(i % 13 == 0, "disabled").otherwise("auto").alias("policy"), (i % 17 != 0).alias("recipe_reusable"), (i % 11 != 0).alias("execution_reusable"),
        h(F.col("event_type")).alias("recipe"), F.when(i % 7 == 0, h(F.lit("x"))).otherwise(h(F.col("event_type"))).alias("c_recipe"),
        h(F.lit("e")).alias("execution"), F.when(i % 19 == 0, F.lit(None)).otherwise(h(F.lit("e"))).alias("c_execution"),
        h(F.col("user_id").cast("string")).alias("inputs"), F.when(i % 5 == 0, h(F.lit("y"))).otherwise(h(F.col("user_id").cast("string"))).alias("c_inputs"),
        ports.alias("task_ports"), F.when(i % 23 == 0, F.array(F.lit("in"), F.lit("more"))).otherwise(ports).alias("c_ports"), (i % 29 != 0).alias("committed"),
        F.lit("op").alias("operation"), F.when(i % 31 == 0, "op2").otherwise("op").alias("b_operation"), good.alias("b_outputs"), good.alias("t_outputs"), good.alias("m_outputs"),
        F.when(i % 37 == 0, F.array().cast("array<string>")).otherwise(good).alias("c_outputs"),
    )


def ports(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.select(i.alias("candidate_id"), F.lit("out").alias("port"), (i % 41 != 0).alias("contract_ok"), (i % 43 != 0).alias("count_ok"), (i % 3 != 0).alias("commit_ok"))


def outputs(t: Tables) -> DataFrame:
    i = F.col("event_id")
    rows = t.events.select(i.alias("candidate_id"), F.lit("out").alias("port"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), i.alias("i"))
    return rows.select("candidate_id", "port", "ord", ((F.col("i") % 2 == 0) & (F.col("ord") == 1)).alias("schema"), ((F.col("i") % 47 == 0) & (F.col("ord") == 0)).alias("manifest_digest"), ((F.col("i") % 8 == 0) & (F.col("ord") == 1)).alias("record_unverified"))


DECISIONS = """c AS (SELECT event_id AS candidate_id, user_id, event_type, ts, value, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'POLICY_OR_RECIPE' WHEN event_id % 11 = 0 THEN 'EXECUTION_WEAK' WHEN event_id % 7 = 0 THEN 'RECIPE_MISMATCH'
  WHEN event_id % 19 = 0 THEN 'EXECUTION_MISMATCH' WHEN event_id % 5 = 0 THEN 'INPUT_MISMATCH' WHEN event_id % 23 = 0 THEN 'INPUT_PORTS' WHEN event_id % 29 = 0 THEN 'UNCOMMITTED' WHEN event_id % 31 = 0 THEN 'BINDING' WHEN event_id % 37 = 0 THEN 'OUTPUT_PORTS'
  WHEN event_id % 41 = 0 THEN 'OUTPUT_CONTRACT' WHEN event_id % 43 = 0 THEN 'OUTPUT_COUNT' WHEN event_id % 3 = 0 THEN 'COMMIT_OUTPUTS' WHEN event_id % 47 = 0 THEN 'MANIFEST_DIGEST' WHEN event_id % 2 = 0 THEN 'SCHEMA' END AS code FROM events)"""


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AS publishable FROM events")
def cch1_can_publish(t: Tables) -> DataFrame:
    return t.events.select("event_id", R.can_publish(F.when(F.col("event_id") % 2 == 0, "auto").otherwise("disabled"), F.col("event_id") % 3 == 0).alias("publishable"))


@query(f"WITH {DECISIONS} SELECT candidate_id, code IS NULL AS accepted, 'CACHE_' || code AS reason FROM c")
def cch2_decide(t: Tables) -> DataFrame:
    return R.decide(candidates(t), ports(t), outputs(t))


#: One output an event; its rule number breaks, 0 none. Products have even, other records odd numbers of hundreds.
BREAKS = ["", "SCHEMA", "MANIFEST_DIGEST", "MANIFEST_SCHEMA", "DECODER_MISSING", "RECORD_SCHEMA", "PRODUCT_PRODUCER", "PROFILE", "PRODUCT_LINEAGE", "PRODUCT_PRODUCTION", "ASSETS_MISSING", "ASSET_UNVERIFIED", "RECORD_UNVERIFIED", "RESULT_IDENTITY", "RECORD_ASSETS_OR_PROFILE", "RECORD_ID", "DUPLICATE_RECORD"]


@query(f"""SELECT event_id AS candidate_id, k = 0 AS accepted, 'CACHE_' || CASE {" ".join(f"WHEN k = {n} THEN '{c}'" for n, c in enumerate(BREAKS) if c)} END AS reason FROM (SELECT event_id, event_id % {len(BREAKS)} AS k FROM events)""")
def cch2_output_rules(t: Tables) -> DataFrame:
    """Every output rule from the facts: an output breaks the rule that its event's number names."""
    k = F.col("event_id") % len(BREAKS)
    when = lambda code, bad, good: F.when(k == BREAKS.index(code), bad).otherwise(good)
    h = lambda x: F.sha2(F.lit(x), 256)
    other = k.isin(BREAKS.index("RECORD_ASSETS_OR_PROFILE"), BREAKS.index("RECORD_ID"))
    manifest = F.concat(F.lit('{"schema_id":"'), when("MANIFEST_SCHEMA", F.lit("z"), F.lit("s")), F.lit('","schema_version":1,"n":'), F.col("event_id"), F.lit("}"))
    struct = lambda **fields: F.struct(*[v.alias(n) for n, v in fields.items()])
    lineage = lambda d: F.array(struct(role=F.lit("in"), digest=d))
    assets = F.array(struct(asset_id=when("ASSETS_MISSING", F.lit("x"), F.lit("a")), same=F.lit(True), strong=when("ASSET_UNVERIFIED", F.lit(False), F.lit(True))))
    rows = t.events.select(
        F.col("event_id").alias("candidate_id"), F.lit("out").alias("port"), F.lit(0).alias("ord"), manifest.cast("binary").alias("manifest"),
        struct(record_id=F.lit("r"), schema_id=F.lit("s"), schema_version=F.lit(1), manifest_digest=when("MANIFEST_DIGEST", h("x"), F.sha2(manifest.cast("binary"), 256)), semantic_digest=h("id")).alias("ref"),
        struct(schema_id=when("SCHEMA", F.lit("q"), F.lit("s")), schema_version=F.lit(1), profile=F.when(~other, F.lit("p"))).alias("want"),
        (k == BREAKS.index("DECODER_MISSING")).alias("decoder_missing"), F.lit(False).alias("record_invalid"),
        struct(
            is_product=~other, schema_id=when("RECORD_SCHEMA", F.lit("q"), F.lit("s")), schema_version=F.lit(1), record_id=when("RECORD_ID", F.lit("x"), F.lit("r")), profile=when("PROFILE", F.lit("q"), F.lit("p")),
            producer=when("PRODUCT_PRODUCER", F.lit("x"), F.lit("plugin")), fingerprint=when("PRODUCT_PRODUCTION", h("x"), h("f")), output_port=F.lit("out"), execution=h("e"), lineage=lineage(when("PRODUCT_LINEAGE", h("x"), h("i"))), asset_ids=F.array(F.lit("a")),
        ).alias("record"),
        struct(producer=F.lit("plugin"), fingerprint=h("f"), execution=h("e"), lineage=lineage(h("i"))).alias("task"),
        F.when(k == BREAKS.index("RECORD_ID"), F.slice(assets, 1, 0)).otherwise(assets).alias("assets"), (k != BREAKS.index("RECORD_UNVERIFIED")).alias("fully_verified"), when("RESULT_IDENTITY", h("x"), h("id")).alias("identity"),
    )
    again = rows.where(F.col("candidate_id") % len(BREAKS) == BREAKS.index("DUPLICATE_RECORD")).withColumn("ord", F.lit(1))
    fine = candidates(t)
    good = {"policy": F.lit("auto"), "recipe_reusable": F.lit(True), "execution_reusable": F.lit(True), "committed": F.lit(True), **{f"c_{x}": F.col(x) for x in ("recipe", "execution", "inputs")}, "c_ports": F.col("task_ports"), "b_operation": F.col("operation"), "c_outputs": F.col("b_outputs")}
    return R.decide(fine.withColumns(good), None, R.output_rules(rows.unionByName(again)))


@query(f"WITH {DECISIONS}, a AS (SELECT *, candidate_id % 4 < 2 AS own, sha256(CAST(candidate_id AS VARCHAR)) AS path FROM c WHERE code IS NULL) SELECT user_id, event_type, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY own DESC, CASE WHEN own THEN -candidate_id END, path) AS n FROM a) WHERE n = 1")
def cch3_select_candidate(t: Tables) -> DataFrame:
    d = R.decide(candidates(t), ports(t), outputs(t)).select("candidate_id", "accepted")
    rows = candidates(t).select("candidate_id", *BY).join(d, "candidate_id")
    rows = rows.withColumn("own_scope", F.col("candidate_id") % 4 < 2).withColumn("sequence", F.col("candidate_id")).withColumn("path", F.sha2(F.col("candidate_id").cast("string"), 256))
    return R.select_candidate(rows, BY)


@query("SELECT user_id, event_type, bool_or(event_id % 5 = 0 AND event_id % 3 = 0) AS damaged, event_type <> 'click' AS restartable, bool_or(event_id % 5 = 0 AND event_id % 3 = 0) AND event_type = 'click' AS forbidden FROM events GROUP BY 1, 2")
def cch4_damage_attribution(t: Tables) -> DataFrame:
    rows = t.events.select(*BY, (F.col("event_id") % 5 == 0).alias("broken"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("started_recipe"), F.col("event_type").alias("recipe"), (F.col("event_type") != "click").alias("restartable"))
    return R.damage_attribution(rows, BY)


@query("""SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (SELECT event_id, 'CACHE_SCHEMA_VERSION' AS code, 'schema_version' AS location FROM events WHERE event_id % 9 = 0
UNION ALL SELECT event_id, 'CACHE_IDENTITY', 'fingerprint' FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'CACHE_INPUT_METADATA', 'ports' FROM events WHERE event_id % 4 = 1 OR event_id % 6 = 2 UNION ALL SELECT event_id, 'CACHE_RECEIPT', 'receipt_digest' FROM events WHERE event_id % 7 = 3)""")
def cch5_check_candidates(t: Tables) -> DataFrame:
    i, d = F.col("event_id"), F.sha2("event_type", 256)
    rows = t.events.select(
        i.alias("candidate_id"), F.when(i % 9 == 0, 2).otherwise(1).alias("schema_version"), F.when(i % 10 == 0, "weak").otherwise(d).alias("fingerprint"), d.alias("execution_identity"),
        F.when(i % 4 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("ports"), F.when(i % 6 == 2, F.array(d, F.lit("x"))).otherwise(F.array(d)).alias("digests"),
        F.when(i % 7 == 3, "bad").when(i % 2 == 0, d).alias("receipt_digest"),
    )
    return R.check_candidates(rows)


@query("SELECT user_id, CASE WHEN value < 30 THEN 'cache_reused' ELSE 'executed' END AS disposition, count(*) AS n_tasks FROM events GROUP BY 1, 2")
def cch6_reuse_stats(t: Tables) -> DataFrame:
    return R.reuse_stats(t.events.select("user_id", F.when(F.col("value") < 30, "cache_reused").otherwise("executed").alias("disposition")), "user_id")


@query("SELECT event_id, event_id % 3 = 2 AS decoder_missing, event_id % 3 = 1 AND event_id % 2 = 0 AS record_invalid, CASE WHEN event_id % 3 = 0 THEN upper(props) WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN props END AS decoded FROM events")
def udx2_with_decoder(t: Tables) -> DataFrame:
    def second(b: bytes) -> str:
        if b.startswith(b"!"):
            raise ValueError
        return b.decode()

    i = F.col("event_id")
    content = F.when((i % 3 == 1) & (i % 2 == 0), F.concat(F.lit("!"), "props")).otherwise(F.col("props"))
    rows = t.events.select("event_id", F.concat(F.lit("s"), i % 3).alias("schema_id"), content.cast("binary").alias("content"))
    return R.decide_records(rows, {"s0": lambda b: b.decode().upper(), "s1": second}).select("event_id", "decoder_missing", "record_invalid", "decoded")
