"""Task graphs (DAG): a plan per order, a task per distinct line number; n depends on n-1 and n/2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import graphs as G
from runloom.plans.history import MICROS
from runloom.plans.registry import Tables, query
from runloom.sources.shared import dealt

NODES = "n AS (SELECT DISTINCT l_orderkey AS plan, l_linenumber AS task FROM lineitem)"
EDGES = f"""{NODES}, e AS (SELECT DISTINCT c.plan, p.task AS parent, c.task AS child FROM n c JOIN n p ON p.plan = c.plan AND (p.task = c.task - 1 OR p.task = c.task // 2) WHERE p.task < c.task)"""
LEVELS = f"WITH RECURSIVE {EDGES}, w(plan, task, level) AS (SELECT plan, task, CAST(0 AS BIGINT) FROM n UNION SELECT e.plan, e.child, w.level + 1 FROM w JOIN e ON e.plan = w.plan AND e.parent = w.task)"


def nodes(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("task")).distinct()


def task_inputs(t: Tables) -> DataFrame:
    n = nodes(t)
    both = n.select(F.col("plan").alias("plan_id"), F.col("task").alias("task_id"), F.explode(F.array_distinct(F.array(F.col("task") - 1, F.floor(F.col("task") / 2).cast("int")))).alias("src_task"))
    there = n.select(F.col("plan").alias("plan_id"), F.col("task").alias("src_task"))
    source = ["plan_id", "src_task"]
    return dealt(both.where("src_task < task_id"), *source).join(dealt(there, *source), source, "left_semi")


def edges(t: Tables) -> DataFrame:
    return G.edges(task_inputs(t))


@query(f"WITH {EDGES} SELECT plan, parent, child FROM e")
def dag1_edges(t: Tables) -> DataFrame:
    return edges(t)


@query(f"WITH {EDGES} SELECT plan, parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM e GROUP BY plan, parent")
def dag2_dependents(t: Tables) -> DataFrame:
    return G.dependents(edges(t)).select("plan", "parent", F.array_join("children", ",").alias("children"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'PLAN_DUPLICATE_TASK' AS code, CAST(l_linenumber AS VARCHAR) AS location FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'error', 'PLAN_SELF_REFERENCE', CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_partkey % 20 = 0
UNION ALL SELECT DISTINCT CAST(c.l_orderkey AS VARCHAR), 'error', 'PLAN_UNKNOWN_TASK', CAST(c.l_linenumber AS VARCHAR) FROM lineitem c WHERE c.l_partkey % 20 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = c.l_orderkey AND p.l_linenumber = c.l_linenumber - 1)""")
def dag3_check_structure(t: Tables) -> DataFrame:
    tasks = t.lineitem.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("task_id"))
    source = F.when(F.col("l_partkey") % 20 == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") - 1)
    inputs = t.lineitem.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("task_id"), F.lit("in").alias("port"), source.alias("src_task"), F.lit("out").alias("src_port"), F.lit(None).cast("string").alias("artifact"))
    outputs = tasks.distinct().withColumn("port", F.lit("out"))
    return G.check_structure(tasks, inputs, outputs)


@query(LEVELS + " SELECT plan, task, max(level) AS level FROM w GROUP BY plan, task")
def dag4_levels(t: Tables) -> DataFrame:
    return G.levels(nodes(t), edges(t))


#: The largest task of a plan feeds its smallest, which so comes last.
@query(f"WITH {NODES}, m AS (SELECT plan, min(task) AS low FROM n GROUP BY plan) SELECT n.plan, CAST(task AS VARCHAR) AS task, row_number() OVER (PARTITION BY n.plan ORDER BY task = low, task) - 1 AS place FROM n JOIN m ON m.plan = n.plan")
def dag5_topological_order(t: Tables) -> DataFrame:
    last = nodes(t).groupBy("plan").agg(F.max("task").alias("parent"), F.min("task").alias("child")).where("parent > child")
    return G.topological_order(nodes(t), last)


@query(f"""WITH RECURSIVE {EDGES}, k AS (SELECT plan, parent, child FROM e UNION SELECT plan, max(task), min(task) FROM n WHERE plan % 3 = 0 GROUP BY plan HAVING count(*) > 1),
r(plan, a, b) AS (SELECT plan, parent, child FROM k UNION SELECT r.plan, r.a, k.child FROM r JOIN k ON k.plan = r.plan AND k.parent = r.b),
c AS (SELECT DISTINCT plan, a FROM r WHERE a = b) SELECT plan, a AS task FROM c UNION SELECT r.plan, r.b FROM r JOIN c ON c.plan = r.plan AND c.a = r.a""")
def dag6_cycles(t: Tables) -> DataFrame:
    back = nodes(t).where("plan % 3 = 0").groupBy("plan").agg(F.max("task").alias("parent"), F.min("task").alias("child")).where("parent > child")
    return G.cycles(G.levels(nodes(t), edges(t).unionByName(back.select("plan", "parent", "child"))))


@query(f"""WITH {EDGES}, k AS (SELECT n.plan, n.task, count(e.parent) AS made FROM n LEFT JOIN e ON e.plan = n.plan AND e.child = n.task GROUP BY n.plan, n.task),
x AS (SELECT CAST(plan AS VARCHAR) || '/' || CAST(task AS VARCHAR) AS subject_id, plan, task, made, CASE WHEN task = 1 AND plan % 4 > 0 THEN 1 ELSE 0 END AS outside FROM k)
SELECT subject_id, 'error' AS kind, 'PLAN_INPUT_COUNT' AS code, 'in' AS location FROM x WHERE made + outside < 1 OR made + outside > CASE WHEN task % 2 = 0 THEN 1 ELSE 2 END
UNION ALL SELECT subject_id, 'error', 'PLAN_OUTPUT_CONTRACT', 'out' FROM x WHERE task = 5
UNION ALL SELECT DISTINCT CAST(plan AS VARCHAR) || '/' || CAST(child AS VARCHAR), 'error', 'PLAN_INPUT_SCHEMA', 'in' FROM e WHERE parent = 5
UNION ALL SELECT subject_id, 'error', 'PLAN_INPUT_SCHEMA', 'in' FROM x WHERE outside = 1 AND plan % 4 = 3
UNION ALL SELECT subject_id, 'unverified', unnest(['PLAN_EXTERNAL_RECORD_UNVERIFIED', 'PLAN_EXTERNAL_PROFILE_UNVERIFIED']), 'in' FROM x WHERE outside = 1
UNION ALL SELECT DISTINCT CAST(plan AS VARCHAR) || '/' || CAST(child AS VARCHAR), 'error', 'PLAN_INPUT_PROFILE', 'in' FROM e WHERE child % 2 = 1 AND parent % 2 = 0
UNION ALL SELECT subject_id, 'error', 'PLAN_CAPABILITY', CASE WHEN plan % 5 = 0 THEN 'gpu,mpi' ELSE 'mpi' END FROM x WHERE plan % 5 < 2 AND task % 2 = 0""")
def dag7_check_ports(t: Tables) -> DataFrame:
    n = nodes(t).select(F.col("plan").alias("plan_id"), F.col("task").alias("task_id"))
    m = F.col("plan_id") % 5
    able = F.when(m == 0, F.array(F.lit("cpu"))).when(m == 1, F.array(F.lit("gpu"))).otherwise(F.array(F.lit("mpi"), F.lit("gpu")))
    tasks = n.select("plan_id", "task_id", F.when(F.col("task_id") % 2 == 0, "even").otherwise("odd").alias("operation_id"), able.alias("capabilities"))
    none = F.lit(None).cast("string")
    inside = task_inputs(t).select("plan_id", "task_id", F.lit("in").alias("port"), "src_task", F.lit("out").alias("src_port"), none.alias("schema_id"))
    outside = n.where("task_id = 1 AND plan_id % 4 > 0").select("plan_id", "task_id", F.lit("in").alias("port"), F.lit(None).cast("int").alias("src_task"), none.alias("src_port"), F.when(F.col("plan_id") % 4 == 3, "other").otherwise("s").alias("schema_id"))
    outputs = n.select("plan_id", "task_id", F.lit("out").alias("port"), F.when(F.col("task_id") == 5, "other").otherwise("s").alias("schema_id"), F.when(F.col("task_id") % 2 == 1, "p").alias("profile_id"), F.lit(1).alias("count"))
    rows = [("even", "input", "in", "s", None, 1, 1), ("odd", "input", "in", "s", "p", 1, 2), ("even", "output", "out", "s", None, 1, 1), ("odd", "output", "out", "s", "p", 1, 1)]
    ports = t.spark.createDataFrame(rows, "operation_id string, direction string, port string, schema_id string, profile_id string, min_count int, max_count int")
    operations = t.spark.createDataFrame([("even", ["mpi", "gpu"]), ("odd", [])], "operation_id string, required_capabilities array<string>")
    return G.check_ports(tasks, inside.unionByName(outside), outputs, ports, operations)


STATES = f"{EDGES}, s AS (SELECT plan, task, CASE WHEN plan % 4 = 0 AND task = 2 THEN 'failed' WHEN task = 1 OR (plan % 4 = 1 AND task < 4) THEN 'succeeded' ELSE 'pending' END AS state FROM n)"


def states(t: Tables) -> DataFrame:
    state = F.when((F.col("plan") % 4 == 0) & (F.col("task") == 2), "failed").when((F.col("task") == 1) | ((F.col("plan") % 4 == 1) & (F.col("task") < 4)), "succeeded").otherwise("pending")
    return nodes(t).withColumn("state", state)


@query(f"""WITH RECURSIVE {STATES}, b(plan, task) AS (SELECT plan, task FROM s WHERE state = 'failed' UNION SELECT e.plan, e.child FROM b JOIN e ON e.plan = b.plan AND e.parent = b.task JOIN s ON s.plan = e.plan AND s.task = e.child AND s.state = 'pending')
SELECT e.plan, e.child AS task, string_agg(CAST(e.parent AS VARCHAR), ',' ORDER BY e.parent) AS blocked_by FROM e JOIN b ON b.plan = e.plan AND b.task = e.parent JOIN s ON s.plan = e.plan AND s.task = e.child AND s.state = 'pending' GROUP BY 1, 2""")
def dag8_blocked(t: Tables) -> DataFrame:
    return G.blocked(edges(t), states(t)).select("plan", "task", F.array_join("blocked_by", ",").alias("blocked_by"))


@query(f"WITH {STATES} SELECT plan, task FROM s WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM e JOIN s p ON p.plan = e.plan AND p.task = e.parent WHERE e.plan = s.plan AND e.child = s.task AND p.state <> 'succeeded')")
def dag9_ready(t: Tables) -> DataFrame:
    return G.ready(edges(t), states(t), now=0.0)


@query(f"WITH {EDGES} SELECT n.plan, n.task, 'unresolved' AS status, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.plan = n.plan AND e.child = n.task) THEN 'EXECUTION_IDENTITY_UNPROBED,UPSTREAM_OUTPUT_PENDING' ELSE 'EXECUTION_IDENTITY_UNPROBED' END AS reasons FROM n")
def dag10_plan_report(t: Tables) -> DataFrame:
    return G.plan_report(nodes(t), edges(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT p_partkey, p_size % 9 <= 4 AND p_size % 2 <= 1 AND (p_size % 5 = 0 OR p_size <= 30) AS feasible FROM part")
def dag11_resource_feasible(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", (F.col("p_size") % 9).alias("cpu"), (F.col("p_size") % 2).alias("gpu"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("memory"))
    return G.resource_feasible(rows, 4, 1, 30).select("p_partkey", "feasible")


@query("""WITH a AS (SELECT user_id, epoch_us(ts) AS s, CASE WHEN event_id % 5 > 0 THEN epoch_us(ts) + (event_id % 7 + 1) * 3600000000 END AS f, event_id % 3 + 1 AS cpu FROM events),
m AS (SELECT user_id, s AS moment, CAST(1 AS BIGINT) AS step, cpu FROM a UNION ALL SELECT user_id, f, CAST(0 AS BIGINT), -cpu FROM a WHERE f IS NOT NULL),
g AS (SELECT user_id, moment, step, sum(cpu) AS cpu FROM m GROUP BY 1, 2, 3)
SELECT user_id, moment, step, CAST(sum(cpu) OVER (PARTITION BY user_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cpu_running FROM g""")
def dag12_resource_timeline(t: Tables) -> DataFrame:
    start = F.expr(MICROS)
    rows = t.events.select("user_id", start.alias("s"), F.when(F.col("event_id") % 5 > 0, start + (F.col("event_id") % 7 + 1) * 3_600_000_000).alias("f"), (F.col("event_id") % 3 + 1).alias("cpu"))
    return G.resource_timeline(rows, ["user_id"], "s", "f", ["cpu"]).withColumnRenamed("at", "moment").withColumn("step", F.col("step").cast("long"))
