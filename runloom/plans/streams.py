"""Streaming jobs (STR) run over files to their end, and file round trips (SRC-2, SRC-3, SNK-2, SNK-4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators import history as H
from runloom.operators import integrity
from runloom.plans.history import MOVES, moves
from runloom.plans.products import INDEX, receipts
from runloom.plans.registry import Tables, query
from runloom.functions.exprs import path_key
from runloom.sources import listing, records
from runloom.sources.shared import shared_folder
from runloom.streaming import live


def new_folder(t: Tables) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(t.spark)}/runloom-{uuid.uuid4().hex}"


def _run(stream: DataFrame, to: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/progress").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {MOVES}, n AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id, task_id ORDER BY ts, event_id), 'pending') AS was, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ts, event_id) AS event_no FROM m) SELECT CAST(run_id AS VARCHAR) AS run_id, task_id, event_no, state, CASE WHEN was <> state AND was || '>' || state NOT IN ({', '.join(f"'{a}>{b}'" for a, b in H.TRANSITIONS)}) THEN was || '>' || state END AS violation FROM n")
def str1_live_state(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    to = new_folder(t)
    w = Window.partitionBy("run_id", "task_id").orderBy("ts", "event_id")
    facts = moves(t).select(F.col("run_id").cast("string").alias("run_id"), "task_id", F.row_number().over(w).cast("long").alias("event_no"), "state")
    facts.write.json(f"{to}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, live.STATE_STORE)
    try:
        _run(live.live_state(live.read_transitions(t.spark, f"{to}/in")), to)
    finally:
        t.spark.conf.unset(key) if before is None else t.spark.conf.set(key, before)
    return t.spark.read.schema(live.LIVE).parquet(f"{to}/out")


@query("SELECT event_id AS attempt_id, ts AS started_at FROM events WHERE event_id % 6 = 0 AND ts < (SELECT least(max(ts), max(ts) FILTER (event_id % 6 <> 0) + INTERVAL 10 MINUTE) FROM events) - INTERVAL 70 MINUTE")
def str2_open_attempts(t: Tables) -> DataFrame:
    to = new_folder(t)
    t.events.select(F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("started_at")).write.parquet(f"{to}/started")
    t.events.where("event_id % 6 <> 0").select(F.col("event_id").alias("finished_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 MINUTE")).alias("ended_at")).write.parquet(f"{to}/finished")
    s = t.spark.readStream.schema("attempt_id long, started_at timestamp").parquet(f"{to}/started")
    f = t.spark.readStream.schema("finished_id long, ended_at timestamp").parquet(f"{to}/finished")
    _run(live.open_attempts(s, f), to)
    return t.spark.read.schema("attempt_id long, started_at timestamp").parquet(f"{to}/out").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("""SELECT user_id, event_type AS task_id, n, CASE WHEN n % 5 = 1 THEN 'RUNTIME_RECORD_VERSION_UNSUPPORTED' WHEN n % 5 = 2 THEN 'RECORD_FIELDS' WHEN n % 5 = 3 THEN 'RECORD_JSON' END AS reject_code,
  CASE WHEN n % 5 IN (0, 4) THEN n % 5 = 0 END AS path_ok FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def src2_read_facts(t: Tables) -> DataFrame:
    """A resolution fact per user and event type, some of them broken, read back and told apart by their paths."""
    to = new_folder(t)
    groups = t.events.groupBy("user_id", F.col("event_type").alias("task_id")).agg(F.count("*").alias("n"))
    m, none = F.col("n") % 5, F.lit(None).cast("string")
    payload = F.struct(
        "task_id", F.lit("succeeded").alias("state"), F.lit("executed").alias("disposition"), none.alias("receipt"), none.alias("error_code"), F.array().cast("array<string>").alias("blocked_by"),
        none.alias("fingerprint"), none.alias("execution"), F.array().cast("array<string>").alias("cache_reasons"),
    )
    fact = F.to_json(F.struct(F.when(m == 1, 1).otherwise(2).alias("schema_version"), F.lit("resolution").alias("kind"), payload.alias("payload")), {"ignoreNullFields": "false"})
    value = F.when(m == 2, F.regexp_replace(fact, '"disposition"', '"other"')).when(m == 3, F.concat(F.lit('{"kind":"x",'), F.substr(fact, F.lit(2)))).otherwise(fact)
    key = path_key(F.col("task_id"))
    path = F.concat(F.lit("runs/"), F.col("user_id"), F.lit("/resolutions/"), F.when(m == 4, F.concat(key, F.lit("x"))).otherwise(key), F.lit(".json"))
    named = groups.select("user_id", "task_id", "n", path.alias("path"))
    records.write_fact_files(groups.select(path.alias("path"), value.alias("value")), f"{to}/facts")
    facts, rejects = records.read_facts(t.spark, f"{to}/facts", "resolution")
    short = F.regexp_extract("path", r"(runs/.*)$", 1).alias("path")
    found = facts.select(short, F.lit(None).cast("string").alias("reject_code"), "path_ok").unionByName(rejects.select(short, "reject_code", F.lit(None).cast("boolean").alias("path_ok")))
    return named.join(found, "path").select("user_id", "task_id", "n", "reject_code", "path_ok")


#: Per fact kind: its path, a payload, and what is put for what to make a place of it another type than asked.
KINDS = {
    "run": ("runs/{u}/run.json", '{"run_id":"{u}","scope_id":"{u}","resume_of":null,"plan_digest":"{d}","engine_identity":{"value":"{d}","reusable":true,"reasons":[]},"implementations":{"p":{"value":null,"reusable":false,"reasons":["WEAK"]}},"source_kind":"programmatic","config_refs":[],"code_provenance":{"package_version":"1","source_revision":null}}', '"reusable":false', '"reusable":0', "$.implementations.p.reusable"),
    "started": ("runs/{u}/attempts/{k}/{u}/started.json", '{"run_id":"{u}","scope_id":"{u}","task_id":"t","attempt_id":"{u}","sequence":1,"plan_digest":"{d}","fingerprint":null,"execution":null,"inputs":[{"port":"in","semantic_digests":["{d}"]}],"allocation":{"cpu_cores":1,"gpu_count":0,"memory_bytes":null},"prepared":{"any":[1,{}]},"started_at":1.5,"resolved_inputs":{"in":[{"artifact":{"record_id":"r","schema_id":"s","schema_version":1,"semantic_digest":"{d}","manifest_digest":"{d}","locator":"l"},"manifest_location":"m","effective_digest":"{d}","evidence":{"any":1}}]}}', '"schema_version":1,', '"schema_version":"1",', "$.resolved_inputs.in[0].artifact.schema_version"),
    "finished": ("runs/{u}/attempts/{k}/{u}/finished.json", '{"attempt_id":"{u}","outcome":"failed","error_code":null,"retryable":false,"ended_at":2,"receipt":null,"evidence":[{"asset_id":"a"}]}', '"retryable":false', '"retryable":"no"', "$.retryable"),
    "receipt": ("runs/{u}/attempts/{k}/{u}/result.json", '{"attempt_id":"{u}","task_id":"t","scope_id":"{u}","fingerprint":"{d}","execution":"{d}","inputs":null,"outputs":{"out":[{"record_id":"r","schema_id":"s","schema_version":1,"semantic_digest":null,"manifest_digest":"{d}","locator":"l"}]},"cache_policy":"auto"}', ',"locator":"l"', "", "$.outputs.out[0].locator"),
    "resolution": ("runs/{u}/resolutions/{k}.json", '{"task_id":"t","state":"blocked","disposition":null,"receipt":null,"error_code":"UPSTREAM_FAILED","blocked_by":["a","b"],"fingerprint":null,"execution":null,"cache_reasons":[]}', '"b"]', "2]", "$.blocked_by[1]"),
    "summary": ("runs/{u}/summary.json", '{"run_id":"{u}","status":"FAILED","states":{"t":"failed"},"completion_order":["t"]}', ':"failed"', ':["failed"]', "$.states.t"),
    "recovery": ("runs/{u}/recovery.json", '{"source_run":"{u}","status":"INTERRUPTED","attempts":[{"attempt_id":"{u}","outcome":"succeeded","receipt":"p"}]}', '"receipt":"p"', '"receipt":"p","more":1', "$.attempts[0].more"),
    "index": ("cache/{u}/{d}.json", '{"receipt":"p","receipt_digest":"{d}"}', '"p"', "1", "$.receipt"),
    "transition": ("runs/{u}/transitions/{u}.json", '{"task_id":"t","state":"pending"}', '"pending"', "{}", "$.state"),
}


def kind_case(values: list[str]) -> str:
    return "CASE user_id % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"""SELECT user_id, {kind_case(list(KINDS))} AS kind, CASE WHEN user_id // 9 % 2 = 1 THEN CASE WHEN user_id % 9 IN (3, 6) THEN 'RECORD_FIELDS' ELSE 'RECORD_TYPE' END END AS reject_code,
  CASE WHEN user_id // 9 % 2 = 1 THEN {kind_case([k[4] for k in KINDS.values()])} END AS reject_path, CASE WHEN user_id // 9 % 2 = 0 THEN true END AS path_ok FROM (SELECT DISTINCT user_id FROM events)""")
def src2_fact_kinds(t: Tables) -> DataFrame:
    """A fact of one of the nine kinds per user, every other one with a place of another type, read back by kind."""
    to = new_folder(t)
    u, d, k = F.md5(F.col("user_id").cast("string")), F.sha2(F.col("user_id").cast("string"), 256), path_key(F.lit("t"))
    filled = lambda text: F.replace(F.replace(F.replace(F.lit(text), F.lit("{u}"), u), F.lit("{d}"), d), F.lit("{k}"), k)
    path = value = F.lit(None).cast("string")
    for i, (kind, (at, payload, was, now, _)) in enumerate(KINDS.items()):
        own = F.col("user_id") % 9 == i
        odd = F.when(F.floor(F.col("user_id") / 9) % 2 == 1, filled(payload.replace(was, now, 1))).otherwise(filled(payload))
        path = F.when(own, filled(at)).otherwise(path)
        value = F.when(own, F.concat(F.lit(f'{{"schema_version":2,"kind":"{kind}","payload":'), odd, F.lit("}"))).otherwise(value)
    facts = t.events.select("user_id").distinct().select("user_id", path.alias("path"), value.alias("value"))
    records.write_fact_files(facts.select("path", "value"), f"{to}/facts")
    short, found = F.regexp_extract("path", r"/facts/(.*)$", 1).alias("path"), None
    texts = records.fact_texts(t.spark, f"{to}/facts")
    for kind in KINDS:
        good, refused = records.read_facts(t.spark, f"{to}/facts", kind, texts=texts)
        none = F.lit(None).cast("string")
        both = good.select(short, none.alias("reject_code"), none.alias("reject_path"), "path_ok").unionByName(refused.select(short, "reject_code", "reject_path", F.lit(None).cast("boolean").alias("path_ok")))
        both = both.withColumn("kind", F.lit(kind))
        found = both if found is None else found.unionByName(both)
    return facts.select("user_id", "path").join(found, "path").select("user_id", "kind", "reject_code", "reject_path", "path_ok")


@query("SELECT 'file' AS kind, CAST(strlen(s_name) + 1 AS BIGINT) AS size_bytes, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def src3_read_inventory(t: Tables) -> DataFrame:
    to = new_folder(t)
    files = t.supplier.select(F.concat(F.lit("d"), F.col("s_suppkey") % 10, F.lit("/"), "s_suppkey", F.lit(".txt")).alias("path"), F.concat("s_name", F.lit("\n")).alias("value"))
    records.write_fact_files(files, f"{to}/files")
    return records.read_inventory(t.spark, f"{to}/files").select("kind", "size_bytes", "sha256")


LISTED = """f AS (SELECT s_suppkey AS k, 'd' || CAST(s_suppkey % 10 AS VARCHAR) AS top, s_name || chr(10) AS body FROM supplier),
o AS (SELECT DISTINCT top AS path, 'directory' AS kind, CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS sha256 FROM f UNION ALL SELECT top || '/' || CAST(k AS VARCHAR), 'directory', NULL, NULL FROM f
  UNION ALL SELECT top || '/' || CAST(k AS VARCHAR) || '/f.txt', 'file', CAST(strlen(body) AS BIGINT), sha256(body) FROM f WHERE k % 3 > 0)"""


def supplier_folder(t: Tables) -> DataFrame:
    """A directory per supplier, every third of them empty, below ten others; as a row of roots."""
    to = new_folder(t)
    own = F.concat(F.lit("d"), F.col("s_suppkey") % 10, F.lit("/"), F.col("s_suppkey"))
    full = F.col("s_suppkey") % 3 > 0
    records.write_fact_files(t.supplier.select(F.when(full, F.concat(own, F.lit("/f.txt"))).otherwise(own).alias("path"), F.when(full, F.concat("s_name", F.lit("\n"))).alias("value")), f"{to}/tree")
    return t.spark.createDataFrame([(1, f"{to}/tree")], "dir_id long, root string")


@query(f"WITH {LISTED} SELECT path, kind, size_bytes, sha256 FROM o")
def src3_list_directories(t: Tables) -> DataFrame:
    return listing.directory_inventory(supplier_folder(t))[0].select("path", "kind", "size_bytes", "sha256")


@query(f"""WITH {LISTED}, m AS (SELECT path, CASE WHEN kind = 'directory' AND path LIKE '%/%5' THEN 'file' ELSE kind END AS kind, size_bytes, CASE WHEN path LIKE '%7/f.txt' THEN sha256('x') ELSE sha256 END AS sha256 FROM o WHERE path NOT LIKE '%4/f.txt'
  UNION ALL SELECT 'missing/' || CAST(k AS VARCHAR), 'file', 1, sha256('x') FROM f WHERE k % 20 = 0)
SELECT '1' AS subject_id, 'error' AS kind, CASE WHEN o.path IS NULL THEN 'member-missing' WHEN m.path IS NULL THEN 'member-unexpected' WHEN m.kind <> o.kind THEN 'member-kind-mismatch' ELSE 'member-integrity-mismatch' END AS code, coalesce(m.path, o.path) AS location
FROM m FULL JOIN o ON o.path = m.path WHERE o.path IS NULL OR m.path IS NULL OR m.kind <> o.kind OR m.sha256 <> o.sha256""")
def int2_listed_directory(t: Tables) -> DataFrame:
    """A manifest held against what a listing found: what is read again of the same suppliers, with some members off."""
    inventory, uncertain, opaque, found = listing.directory_inventory(supplier_folder(t))
    k, file = F.col("s_suppkey"), F.lit("file")
    own = F.concat(F.lit("d"), k % 10, F.lit("/"), k)
    body = F.concat("s_name", F.lit("\n"))
    row = lambda path, kind, size, digest: [path.alias("path"), kind.alias("member_kind"), size.cast("long").alias("size_bytes"), digest.cast("string").alias("digest")]
    tops = t.supplier.select(*row(F.concat(F.lit("d"), k % 10), F.lit("directory"), F.lit(None), F.lit(None))).distinct()
    places = t.supplier.select(*row(own, F.when(k % 10 == 5, "file").otherwise("directory"), F.lit(None), F.lit(None)))
    inside = t.supplier.where("s_suppkey % 3 > 0 AND s_suppkey % 10 <> 4").select(*row(F.concat(own, F.lit("/f.txt")), file, F.octet_length(body), F.when(k % 10 == 7, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(body, 256))))
    gone = t.supplier.where("s_suppkey % 20 = 0").select(*row(F.concat(F.lit("missing/"), k), file, F.lit(1), F.sha2(F.lit("x"), 256)))
    members = tops.unionByName(places).unionByName(inside).unionByName(gone).select(F.lit(1).cast("long").alias("dir_id"), "*", F.lit("sha256").alias("algorithm"))
    issues = integrity.suppress_uncertain(integrity.reconcile_directory(members, inventory), uncertain, opaque)
    return issues.select("subject_id", "kind", "code", "location").unionByName(found)


@query("SELECT o_orderkey, o_custkey FROM orders")
def snk2_write_resolved(t: Tables) -> DataFrame:
    to = new_folder(t)
    records.write_resolved(t.orders.select("o_orderkey", "o_custkey"), f"{to}/resolved")
    return t.spark.read.parquet(f"{to}/resolved")


@query(INDEX)
def snk4_rebuild_reuse_index(t: Tables) -> DataFrame:
    to = new_folder(t)
    records.publish_reuse_index(receipts(t), f"{to}/index")
    return t.spark.read.schema("fingerprint string, receipt string, recipe_prefix string").parquet(f"{to}/index")
