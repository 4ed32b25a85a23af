"""Run history (HIS): a run per user, a task per event type, attempts in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import history as H
from runloom.plans.registry import Tables, query

#: Outcome of an attempt by its value; every eleventh attempt has no end, every thirteenth breaks a rule.
A = """a AS (SELECT event_id, user_id AS run_id, event_type AS task_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS sequence,
  CASE WHEN value < 30 THEN 'succeeded' WHEN value < 60 THEN 'failed' ELSE 'interrupted' END AS outcome, value >= 30 AND value < 45 AS retryable, epoch_us(ts) AS ended_at FROM events),
p AS (SELECT * FROM a WHERE event_id % 11 <> 0)"""
RUNS = "r AS (SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 4 > 0 THEN user_id - 1 END AS resume_of, user_id // 4 AS scope_id, CASE WHEN user_id % 12 = 7 THEN 'other' ELSE 'plan' END AS plan_digest FROM events)"


#: Microseconds since 1970 of a timestamp without time zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def attempts(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    v = F.col("value")
    return t.events.select(
        "event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"), F.col("event_id").alias("attempt_id"), "ts", "value", F.row_number().over(w).alias("sequence"),
        F.when(v < 30, "succeeded").when(v < 60, "failed").otherwise("interrupted").alias("outcome"), ((v >= 30) & (v < 45)).alias("retryable"),
        F.when((v >= 30) & (v < 45), "EXECUTION_RETRYABLE").when((v >= 45) & (v < 60), "EXECUTION_FAILED").alias("error_code"), F.expr(MICROS).alias("ended_at"),
    )


def started(t: Tables) -> DataFrame:
    return attempts(t).select("run_id", "task_id", "attempt_id", "sequence", F.sha2("task_id", 256).alias("fingerprint"), F.lit("plan").alias("plan_digest"), (F.col("run_id") % 5).alias("scope_id"), F.sha2(F.lit("x"), 256).alias("execution"))


def finished(t: Tables) -> DataFrame:
    a = attempts(t).where("event_id % 11 <> 0")
    receipt = F.when((F.col("outcome") == "succeeded") & (F.col("event_id") % 13 != 0), F.lit("result.json"))
    return a.select("attempt_id", "outcome", F.when(F.col("event_id") % 17 == 0, "EXECUTION_FAILED").otherwise(F.col("error_code")).alias("error_code"), "retryable", "ended_at", receipt.alias("receipt"))


def runs(t: Tables) -> DataFrame:
    u = F.col("user_id")
    rows = t.events.select("user_id").distinct()
    return rows.select(u.alias("run_id"), F.when(u % 4 > 0, u - 1).alias("resume_of"), F.floor(u / 4).alias("scope_id"), F.when(u % 12 == 7, "other").otherwise("plan").alias("plan_digest"))


BY = ["run_id", "task_id"]


#: What is broken in every ninth event's fact of a kind, by (kind, variant): code and field.
BROKEN = {
    (0, 1): [("RECORD_VALUE", "run_id")], (0, 2): [("RECORD_IDENTITY", "engine_identity")], (0, 3): [("RECORD_CODE_PROVENANCE", "code_provenance")],
    (1, 1): [("RECORD_VALUE", "sequence")], (1, 2): [("RECORD_INPUT_PORTS", "inputs"), ("RECORD_EFFECTIVE_INPUT_BINDING", "resolved_inputs")], (1, 3): [("RECORD_EFFECTIVE_INPUT_BINDING", "resolved_inputs")],
    (2, 1): [("RECORD_VALUE", "outcome")], (2, 2): [("RECORD_OUTCOME", "receipt")], (2, 3): [("RECORD_OUTCOME", "retryable")],
    (3, 1): [("RECORD_VALUE", "outputs")], (3, 2): [("RECORD_VALUE", "cache_policy")], (3, 3): [("RECORD_INPUTS", "inputs")],
    (4, 1): [("RECORD_VALUE", "state")], (4, 2): [("RECORD_RESOLUTION_EVIDENCE", "fingerprint")], (4, 3): [("RECORD_VALUE", "error_code")],
    (5, 1): [("RECORD_VALUE", "status")], (5, 2): [("RECORD_VALUE", "states")], (5, 3): [("RECORD_VALUE", "completion_order")],
    (6, 1): [("RECORD_VALUE", "status")], (6, 2): [("RECORD_RECOVERY", "attempts")], (6, 3): [("RECORD_RECOVERY", "attempts")],
    (7, 1): [("RECORD_VALUE", "receipt")], (7, 2): [("RECORD_VALUE", "receipt_digest")], (7, 3): [("RECORD_VALUE", "receipt"), ("RECORD_VALUE", "receipt_digest")],
    (8, 1): [("RECORD_VALUE", "state")], (8, 2): [("RECORD_VALUE", "task_id")], (8, 3): [("RECORD_VALUE", "task_id"), ("RECORD_VALUE", "state")],
}
_BROKEN_SQL = ", ".join(f"({k}, {b}, '{code}', '{field}')" for (k, b), found in BROKEN.items() for code, field in found)


def facts(t: Tables) -> dict[str, DataFrame]:
    """A fact of one of the nine kinds per event; three of four of them break a rule."""
    i = F.col("event_id")
    b = F.floor(i / 9) % 4
    key, digest, none = F.md5(i.cast("string")), F.sha2(i.cast("string"), 256), F.lit(None).cast("string")
    strings = lambda *x: F.array(*x).cast("array<string>")
    identity = F.struct(F.when(b != 2, digest).alias("value"), F.lit(True).alias("reusable"), strings().alias("reasons"))
    port = lambda p, d: F.struct(F.lit(p).alias("port"), F.array(d).alias("semantic_digests"))
    source = lambda d: F.array(F.struct(none.alias("artifact"), F.lit("m.json").alias("manifest_location"), d.alias("effective_digest"), none.alias("evidence")))
    other = F.when(b == 3, F.sha2(F.lit("other"), 256)).otherwise(digest)
    started_inputs = F.when(b == 2, F.array(port("b", digest), port("a", digest))).otherwise(F.array(port("a", other), port("b", digest)))
    done = F.when(b == 2, "succeeded").when(b == 1, "done").otherwise("failed")
    columns = {
        "run": dict(run_id=F.when(b == 1, "short").otherwise(key), scope_id=key, resume_of=none, plan_digest=digest, engine_identity=identity, implementations=F.create_map(F.lit("p"), F.struct(digest.alias("value"), F.lit(True).alias("reusable"), strings().alias("reasons"))),
                    source_kind=F.lit("programmatic"), config_refs=strings(), code_provenance=F.struct(F.lit("1").alias("package_version"), F.when(b == 3, "zz").alias("source_revision"))),
        "started": dict(run_id=key, scope_id=key, task_id=F.lit("t"), attempt_id=key, sequence=F.when(b == 1, 0).otherwise(1), plan_digest=digest, fingerprint=digest, execution=none, inputs=started_inputs,
                        allocation=F.struct(F.lit(1).alias("cpu_cores"), F.lit(0).alias("gpu_count"), F.lit(None).cast("long").alias("memory_bytes")), prepared=F.lit("{}"), started_at=F.lit(1.5), resolved_inputs=F.create_map(F.lit("b"), source(digest), F.lit("a"), source(digest))),
        "finished": dict(attempt_id=key, outcome=done, error_code=F.when(b == 0, "EXECUTION_RETRYABLE").when(b == 3, "EXECUTION_FAILED"), retryable=b.isin(0, 3), ended_at=F.lit(2.0), receipt=none, evidence=strings()),
        "receipt": dict(attempt_id=key, task_id=F.lit("t"), scope_id=key, fingerprint=digest, execution=digest, inputs=F.array(port("a", F.when(b == 3, "weak").otherwise(digest))), outputs=F.when(b == 1, F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("o"), strings(key))),
                        cache_policy=F.when(b == 2, "maybe").otherwise("auto")),
        "resolution": dict(task_id=F.lit("t"), state=F.when(b == 1, "running").otherwise("failed"), disposition=none, receipt=none, error_code=F.when(b == 3, "X").otherwise("UPSTREAM_FAILED"), blocked_by=strings(F.lit("s")), fingerprint=F.when(b == 2, "weak"), execution=none, cache_reasons=strings()),
        "summary": dict(run_id=key, status=F.when(b == 1, "DONE").otherwise("FAILED"), states=F.create_map(F.lit("t"), F.when(b == 2, "odd").otherwise("failed")), completion_order=strings(F.when(b == 3, "").otherwise("t"))),
        "recovery": dict(source_run=key, status=F.when(b == 1, "OK").otherwise("INTERRUPTED"), attempts=F.array(F.struct(key.alias("attempt_id"), F.when(b == 2, "succeeded").otherwise("interrupted").alias("outcome"), F.when(b == 3, "r").alias("receipt")))),
        "index": dict(receipt=F.when(b.isin(1, 3), "").otherwise("r"), receipt_digest=F.when(b.isin(2, 3), "weak").otherwise(digest)),
        "transition": dict(task_id=F.when(b.isin(2, 3), "").otherwise("t"), state=F.when(b.isin(1, 3), "gone").otherwise("running")),
    }
    return {kind: t.events.where(i % 9 == k).select(i.alias("fact_no"), *[x.alias(n) for n, x in cols.items()]) for k, (kind, cols) in enumerate(columns.items())}


@query(f"SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM events JOIN (VALUES {_BROKEN_SQL}) AS x(k, b, code, location) ON event_id % 9 = k AND (event_id // 9) % 4 = b")
def his1_check_facts(t: Tables) -> DataFrame:
    out = None
    for kind, rows in facts(t).items():
        found = H.check_facts(kind, rows, F.col("fact_no"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {A}, {RUNS}, s AS (SELECT *, event_id % 11 <> 0 AS ended FROM a)
SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (
SELECT event_id, 'ATTEMPT_HISTORY_BINDING' AS code, 'scope_id' AS location FROM s JOIN r ON r.run_id = s.run_id WHERE s.run_id % 5 <> r.scope_id
UNION ALL SELECT event_id, 'ATTEMPT_HISTORY_BINDING', 'plan_digest' FROM s JOIN r ON r.run_id = s.run_id WHERE r.plan_digest <> 'plan'
UNION ALL SELECT event_id, 'ATTEMPT_HISTORY_BINDING', 'task_id' FROM s WHERE task_id = 'click'
UNION ALL SELECT event_id, 'ATTEMPT_HISTORY_BINDING', 'path' FROM s WHERE event_id % 19 = 0
UNION ALL SELECT event_id, 'ATTEMPT_HISTORY_INVALID', 'receipt' FROM s WHERE ended AND outcome = 'succeeded' AND (event_id % 13 = 0 OR event_id % 7 = 0))""")
def his2_check_attempts(t: Tables) -> DataFrame:
    i = F.col("attempt_id")
    own = F.concat_ws("/", F.lit("runs"), "run_id", F.lit("attempts"), F.sha2("task_id", 256), "attempt_id")
    paired = H.pair_attempts(started(t), finished(t)).withColumn("path", F.when(i % 19 == 0, F.concat(own, F.lit("x"))).otherwise(own))
    receipt = F.when(F.col("receipt").isNotNull(), F.concat(F.when(i % 7 == 0, F.lit("elsewhere")).otherwise(F.col("path")), F.lit("/result.json")))
    tasks = t.events.where("event_type <> 'click'").select(F.lit("plan").alias("plan_digest"), F.col("event_type").alias("task_id")).distinct()
    return H.check_attempts(paired.withColumn("receipt", receipt), runs(t), tasks)


@query(f"WITH {A} SELECT run_id, task_id, event_id AS attempt_id, CASE WHEN event_id % 11 <> 0 THEN outcome END AS outcome, event_id % 11 = 0 AS open FROM a")
def his2_pair_attempts(t: Tables) -> DataFrame:
    return H.pair_attempts(started(t), finished(t)).select("run_id", "task_id", "attempt_id", "outcome", "open")


@query(f"WITH {A} SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, 'ATTEMPT_SEQUENCE' AS code, CAST(place AS VARCHAR) AS location FROM (SELECT event_id, sequence, row_number() OVER (PARTITION BY run_id, task_id ORDER BY sequence, event_id) AS place FROM a WHERE event_id % 40 <> 0) WHERE place <> sequence")
def his3_check_sequence(t: Tables) -> DataFrame:
    return H.check_sequence(attempts(t).where("event_id % 40 <> 0"), BY)


@query("SELECT user_id AS run_id, event_type AS task_id, count(*) AS n_running, count(*) FILTER (event_id % 40 <> 0) AS n_attempts FROM events GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (event_id % 40 <> 0)")
def his4_missing_attempts(t: Tables) -> DataFrame:
    moves = t.events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"), F.lit("running").alias("state"))
    return H.missing_attempts(moves, attempts(t).where("event_id % 40 <> 0"), BY)


@query(f"WITH {A}, {RUNS} SELECT a.run_id, task_id, event_id AS attempt_id, sequence FROM a JOIN r ON r.run_id = a.run_id WHERE scope_id = 3 AND plan_digest = 'plan'")
def his5_scope_history(t: Tables) -> DataFrame:
    return H.scope_history(runs(t), attempts(t), F.lit(3), F.lit("plan")).select("run_id", "task_id", "attempt_id", F.col("sequence").cast("long"))


DECISION = f"{A}, l AS (SELECT run_id, task_id, count(*) AS n_attempts, arg_max(outcome, sequence) AS outcome, arg_max(retryable, sequence) AS retryable, arg_max(ended_at, sequence) AS ended_at FROM a GROUP BY 1, 2), d AS (SELECT *, (outcome = 'interrupted' OR (outcome = 'failed' AND retryable)) AND task_id <> 'click' AND n_attempts < 15 AS retry FROM l)"


def decisions(t: Tables) -> DataFrame:
    policies = t.events.select(F.col("event_type").alias("task_id")).distinct().select("task_id", F.lit(15).alias("max_attempts"), (F.col("task_id") != "click").alias("restartable"), F.lit(5_000_000).alias("backoff"))
    return H.retry_decision(attempts(t), policies, BY)


@query(f"WITH {DECISION} SELECT run_id, task_id, n_attempts, outcome, retry FROM d")
def his6_retry_decision(t: Tables) -> DataFrame:
    return decisions(t).select("run_id", "task_id", "n_attempts", "outcome", "retry")


@query(f"WITH {DECISION} SELECT run_id, task_id, CAST(ended_at + 5000000 AS DOUBLE) AS ready_at FROM d WHERE retry")
def his7_next_ready(t: Tables) -> DataFrame:
    return H.next_ready(decisions(t)).select("run_id", "task_id", F.col("ready_at").cast("double").alias("ready_at"))


def sealed(t: Tables) -> DataFrame:
    fp = F.when(F.col("attempt_id") % 22 == 0, F.sha2("task_id", 256)).otherwise(F.sha2(F.lit("other"), 256))
    return started(t).where("attempt_id % 33 <> 0").withColumn("fingerprint", fp)


@query(f"WITH {A} SELECT run_id, task_id, event_id AS attempt_id, CASE WHEN event_id % 33 <> 0 AND event_id % 22 = 0 THEN 'succeeded' ELSE 'interrupted' END AS outcome FROM a WHERE event_id % 11 = 0 AND run_id % 3 <> 0")
def his8_recover(t: Tables) -> DataFrame:
    return H.recover(runs(t), started(t), finished(t), sealed(t), runs(t).where("run_id % 3 = 0").select("run_id"))


TERMINAL = f"{A}, k AS (SELECT DISTINCT run_id, task_id FROM a), o AS (SELECT run_id, task_id, arg_max(outcome, sequence) AS outcome FROM a WHERE sequence > 3 GROUP BY 1, 2), z AS (SELECT k.run_id, k.task_id, CASE WHEN k.run_id % 9 = 0 THEN 'blocked' WHEN outcome = 'succeeded' THEN 'succeeded' ELSE 'failed' END AS state FROM k LEFT JOIN o ON o.run_id = k.run_id AND o.task_id = k.task_id)"


def resolutions(t: Tables) -> DataFrame:
    return attempts(t).select(*BY).distinct().where("run_id % 9 = 0").withColumn("state", F.lit("blocked"))


def terminal(t: Tables) -> DataFrame:
    return H.terminal_states(attempts(t), attempts(t).where("sequence > 3"), resolutions(t), BY)


@query(f"WITH {TERMINAL} SELECT run_id, task_id, state FROM z")
def his9_terminal_states(t: Tables) -> DataFrame:
    return terminal(t)


@query(f"WITH {TERMINAL} SELECT run_id, task_id, state, CASE WHEN state = 'succeeded' THEN 'executed' END AS disposition, CASE WHEN state <> 'succeeded' THEN CASE WHEN run_id % 2 = 0 THEN 'INTERRUPTED' ELSE 'PREFLIGHT_FAILED' END END AS error_code FROM z WHERE run_id % 9 <> 0")
def his10_synthesize_resolutions(t: Tables) -> DataFrame:
    status = runs(t).select("run_id", F.when(F.col("run_id") % 2 == 0, "interrupted").otherwise("failed").alias("status"))
    return H.synthesize_resolutions(terminal(t), resolutions(t), status, BY)


@query(f"WITH {RUNS} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'succeeded' WHEN run_id % 3 = 0 THEN 'interrupted' ELSE 'running' END AS status FROM r")
def his11_run_status(t: Tables) -> DataFrame:
    r = runs(t)
    return H.run_status(r, r.where("run_id % 2 = 0").select("run_id", F.lit("succeeded").alias("status")), r.where("run_id % 3 = 0").select("run_id", F.lit("interrupted").alias("status")))


@query(f"WITH {TERMINAL} SELECT run_id, CASE WHEN bool_and(state = 'succeeded') THEN 'succeeded' ELSE 'failed' END AS status, string_agg(task_id || '=' || state, ',' ORDER BY task_id) AS states FROM z GROUP BY run_id")
def his12_summarize_run(t: Tables) -> DataFrame:
    return H.summarize_run(terminal(t)).withColumn("states", F.array_join(F.transform("states", lambda s: F.concat_ws("=", s["task"], s["state"])), ","))


MOVES = "m AS (SELECT event_id, user_id AS run_id, event_type AS task_id, ts, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'blocked' END AS state FROM events)"


def moves(t: Tables) -> DataFrame:
    m = F.floor("value") % 5
    state = F.when(m == 0, "pending").when(m == 1, "running").when(m == 2, "succeeded").when(m == 3, "failed").otherwise("blocked")
    return t.events.select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"), "ts", state.alias("state"))


@query(f"WITH {MOVES} SELECT run_id, task_id, arg_max(state, (ts, event_id)) AS state FROM m GROUP BY 1, 2")
def his13_current_state(t: Tables) -> DataFrame:
    return H.current_state(moves(t), BY, F.struct("ts", "event_id"))


@query(f"""WITH {MOVES}, w AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id, task_id ORDER BY ts, event_id), 'pending') AS was FROM m)
SELECT run_id, task_id, event_id, was, state FROM w WHERE was <> state AND was || '>' || state NOT IN ({", ".join(f"'{a}>{b}'" for a, b in H.TRANSITIONS)})""")
def his14_check_transitions(t: Tables) -> DataFrame:
    return H.check_transitions(moves(t), BY, ["ts", "event_id"]).select("run_id", "task_id", "event_id", "was", "state")


@query(f"WITH {A} SELECT run_id, string_agg(task_id, ',' ORDER BY ts, event_id) AS completion_order FROM p WHERE outcome = 'succeeded' GROUP BY run_id")
def his15_completion_order(t: Tables) -> DataFrame:
    done = attempts(t).where("event_id % 11 <> 0 AND outcome = 'succeeded'")
    return H.completion_order(done, "run_id", "task_id", ["ts", "event_id"]).withColumn("completion_order", F.array_join("completion_order", ","))


@query(f"""WITH {RUNS}, s AS (SELECT event_id, user_id AS run_id, user_id % 5 AS scope_id FROM events WHERE event_id % 33 <> 0)
SELECT CAST(event_id AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (
SELECT event_id, 'RECEIPT_BINDING' AS code, 'fingerprint' AS location FROM s WHERE event_id % 22 <> 0
UNION ALL SELECT event_id, 'RECEIPT_BINDING', 'inputs' FROM s WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 'RECEIPT_ATTEMPT', 'path' FROM s WHERE event_id % 19 = 0
UNION ALL SELECT event_id, 'RECEIPT_EXECUTION_EVIDENCE', 'execution' FROM s WHERE event_id % 23 = 0
UNION ALL SELECT event_id, 'START_BINDING', 'scope_id' FROM s JOIN r ON r.run_id = s.run_id WHERE s.scope_id <> r.scope_id
UNION ALL SELECT event_id, 'START_BINDING', 'plan_digest' FROM s JOIN r ON r.run_id = s.run_id WHERE r.plan_digest <> 'plan')""")
def his16_check_receipts(t: Tables) -> DataFrame:
    i = F.col("attempt_id")
    digests = lambda c: F.array(F.struct(F.lit("in").alias("port"), F.array(F.sha2(c, 256)).alias("semantic_digests")))
    path = F.concat_ws("/", F.lit("runs"), "run_id", F.lit("attempts"), F.sha2("task_id", 256), F.when(i % 19 == 0, "x").otherwise(i.cast("string")))
    first = started(t).withColumn("inputs", digests(i.cast("string"))).withColumn("path", path).withColumn("recomputed_execution", F.when(i % 23 != 0, F.col("execution")))
    return H.check_receipts(sealed(t).withColumn("inputs", digests(F.when(i % 5 == 0, "x").otherwise(i.cast("string")))), first, runs(t))


ADOPTED = f"""WITH RECURSIVE {RUNS}, c(run_id, ancestor, depth, broken) AS (SELECT run_id, run_id, CAST(0 AS BIGINT), false FROM r
UNION ALL SELECT c.run_id, b.run_id, depth + 1, a.scope_id <> b.scope_id OR a.plan_digest <> b.plan_digest FROM c JOIN r a ON a.run_id = c.ancestor JOIN r b ON b.run_id = a.resume_of WHERE NOT broken),
g AS (SELECT DISTINCT user_id AS run_id, event_type AS task_id FROM events WHERE (user_id + length(event_type)) % 3 = 0),
x AS (SELECT c.run_id, g.task_id, min(depth) AS depth FROM c JOIN g ON g.run_id = c.ancestor WHERE c.run_id NOT IN (SELECT run_id FROM c WHERE broken) GROUP BY 1, 2)"""


def adopted(t: Tables) -> DataFrame:
    rows = attempts(t).select(*BY).distinct().where("(run_id + length(task_id)) % 3 = 0")
    return H.adopted_identity(runs(t), rows.select(*BY, F.lit("succeeded").alias("state"), F.sha2("task_id", 256).alias("fingerprint"), F.sha2(F.col("run_id").cast("string"), 256).alias("execution")))


@query(ADOPTED + " SELECT run_id, task_id, sha256(task_id) AS fingerprint, sha256(CAST(run_id - depth AS VARCHAR)) AS execution, depth FROM x")
def his17_adopted_identity(t: Tables) -> DataFrame:
    return adopted(t)


@query(ADOPTED + """, k AS (SELECT DISTINCT user_id AS run_id, event_type AS task_id FROM events)
SELECT k.run_id, bool_or(k.run_id % 10 = 0 OR coalesce(x.depth > 0, false) OR (k.run_id % 7 = 0 AND k.task_id = 'view')) AS replan_required FROM k LEFT JOIN x ON x.run_id = k.run_id AND x.task_id = k.task_id GROUP BY k.run_id""")
def his18_replan_required(t: Tables) -> DataFrame:
    now = attempts(t).select(*BY).distinct().select(*BY, F.when(F.col("run_id") % 10 != 0, F.sha2("task_id", 256)).alias("fingerprint"), F.sha2(F.col("run_id").cast("string"), 256).alias("execution"))
    tried = F.when((F.col("run_id") % 7 == 0) & (F.col("task_id") == "view"), F.sha2(F.lit("x"), 256)).otherwise(F.when(F.col("run_id") % 10 != 0, F.sha2("task_id", 256)))
    past = attempts(t).select(*BY, tried.alias("fingerprint"), F.sha2(F.col("run_id").cast("string"), 256).alias("execution"))
    return H.replan_required(now, adopted(t), BY, past)


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 1 THEN sha256(o_orderstatus) END AS effective_digest, o_orderkey % 3 = 2 AS conflict FROM orders""")
def his19_effective_inputs(t: Tables) -> DataFrame:
    refs = t.orders.select(F.col("o_orderkey").alias("record_id"), F.sha2("o_orderstatus", 256).alias("semantic_digest"))
    proof = t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 3 == 1, F.sha2("o_orderstatus", 256)).otherwise(F.sha2("o_orderpriority", 256)).alias("recomputed"))
    return H.effective_inputs(refs, proof).select("record_id", "effective_digest", "conflict")


@query("""WITH l AS (SELECT event_id AS k FROM events WHERE event_id % 13 <> 0),
i AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'INPUT_RECEIPT_BINDING' WHEN k % 7 = 0 THEN 'INPUT_RECEIPT_LOCATION' WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'INPUT_COMMITTED_REF_CONFLICT' END AS code FROM l)
SELECT CAST(k AS VARCHAR) AS record_id, code, code IS NULL AND k % 11 > 0 AND k % 2 = 1 AS proven FROM i WHERE code IS NOT NULL OR (k % 11 > 0 AND k % 2 = 1)""")
def his20_local_evidence(t: Tables) -> DataFrame:
    """A reference, a receipt and a started fact per event."""
    k, h = F.col("event_id"), lambda x: F.sha2(x, 256)
    text = k.cast("string")
    kind = F.when(k % 13 == 0, "elsewhere").otherwise("manifests")
    refs = t.events.select(text.alias("record_id"), F.concat_ws("/", F.lit("runs"), F.when(k % 7 == 0, "x").otherwise(F.col("user_id").cast("string")), F.lit("attempts"), h(F.col("event_type")), text, kind, F.lit("m.json")).alias("locator"), h(text).alias("reference"))
    output = F.struct(F.lit("out").alias("port"), F.when(k % 11 == 0, "none").otherwise(text).alias("record_id"), h(F.when(k % 3 == 0, "x").otherwise(text)).alias("reference"))
    facts = t.events.select(k.alias("attempt_id"), F.col("event_type").alias("task_id"), F.lit("s").alias("scope_id"), F.when(k % 2 == 1, h(text)).alias("fingerprint"), h(F.lit("e")).alias("execution"), F.array(output).alias("outputs"), F.col("user_id").alias("run_id"))
    proven, found = H.local_evidence(refs, facts.drop("run_id"), facts.withColumn("execution", F.when(F.col("attempt_id") % 5 == 0, h(F.lit("x"))).otherwise(F.col("execution"))))
    return found.select(F.col("subject_id").alias("record_id"), "code", F.lit(False).alias("proven")).unionByName(proven.select("record_id", F.lit(None).cast("string").alias("code"), F.lit(True).alias("proven")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'EXECUTION_RETRYABLE' WHEN 'view' THEN 'CONTRACT_INVALID' ELSE 'EXECUTION_FAILED' END AS error_code, event_type = 'click' AS retryable FROM events")
def his21_classify_errors(t: Tables) -> DataFrame:
    cause = F.when(F.col("event_type") == "click", "retryable").when(F.col("event_type") == "view", "contract").otherwise("else")
    return H.classify_errors(t.events.withColumn("cause", cause)).select("event_id", "error_code", "retryable")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'RECORD_EFFECTIVE_INPUT_BINDING' AS code, 'inputs' AS location FROM lineitem GROUP BY l_orderkey HAVING (l_orderkey % 4 = 0) <> bool_or(l_partkey % 50 = 0)")
def his22_check_evidence_inputs(t: Tables) -> DataFrame:
    digest = F.when(F.col("l_partkey") % 50 != 0, F.sha2(F.col("l_partkey").cast("string"), 256))
    item = F.struct(F.concat(F.lit("p"), F.col("l_linenumber") % 2).alias("port"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), digest.alias("effective_digest"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(item).alias("resolved"))
    ports = F.array_sort(F.array_distinct(F.transform("resolved", lambda r: r["port"])))
    by = lambda p: F.transform(F.array_sort(F.filter("resolved", lambda r: r["port"] == p), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)), lambda r: r["effective_digest"])
    whole = F.transform(ports, lambda p: F.struct(p.alias("port"), by(p).alias("semantic_digests")))
    return H.check_evidence_inputs(rows.withColumn("inputs", F.when(F.col("l_orderkey") % 4 != 0, whole)), "l_orderkey")
