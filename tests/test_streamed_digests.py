"""Digests put together row by row: large groups, sections, nulls, and whole plans whose rows come in any order."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from runloom.functions import digests as D


def sha(domain, text):
    return hashlib.sha256(domain.encode() + b"\0" + text.encode()).hexdigest()


def test_a_million_members_of_one_directory(spark):
    n = 1_000_000
    members = spark.range(n).selectExpr("IF(id < 5, 'small', 'large') AS dir_id", "lpad(id, 9, '0') AS path", "'file' AS kind", "IF(id = 3, 'weak', sha2(CAST(id AS STRING), 256)) AS digest")
    got = {r.dir_id: (r.identity.value, list(r.identity.reasons)) for r in D.directory_digest(members).collect()}
    h = hashlib.sha256(b"runloom.directory.v1\0[")
    for i in range(5, n):
        h.update(f"{',' if i > 5 else ''}".encode() + json.dumps({"path": f"{i:09}", "kind": "file", "digest": hashlib.sha256(str(i).encode()).hexdigest()}, separators=(",", ":")).encode())
    h.update(b"]")
    assert got == {"large": (h.hexdigest(), []), "small": (None, ["MEMBER_UNVERIFIED"])}


def test_sections_nulls_and_ties(spark):
    rows = [("a", 1, 2, "y"), ("a", 1, 1, "x"), ("a", 0, 5, "p"), ("a", 1, 2, "y"), ("a", 1, None, "n"), ("b", 1, 1, None), (None, 0, 1, "é\n"), ("c", 0, 1, "")]
    df = spark.createDataFrame(rows, "g string, s int, o int, t string").repartition(3)
    got = {r.g: (r.digest, r.n) for r in D.streamed_digest(df, ["g"], ["o"], F.col("t"), "d", ["{", "|", "}"], F.col("s")).collect()}
    assert got == {"a": (sha("d", "{p|n,x,y,y}"), 5), "b": (sha("d", "{|}"), 0), None: (sha("d", "{é\n|}"), 1), "c": (sha("d", "{|}"), 1)}
    assert D.streamed_digest(df.limit(0), ["g"], ["o"], F.col("t"), "d", ["", ""]).collect() == []


def test_lineage_keeps_order_and_repeats(spark):
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3)]
    rows = [("t", "b", 1, h[0]), ("t", "a", 2, h[1]), ("t", "a", 1, h[1]), ("u", "a", 1, "weak"), ("v", "a", 1, h[2])]
    df = spark.createDataFrame(rows, "task string, port string, ord int, semantic_digest string")
    got = {r.task: (r.digest, r.n) for r in D.input_lineage_digest(df, ["task"]).collect()}
    text = "[" + ",".join(f'{{"port":"{p}","semantic_digest":"{x}"}}' for p, x in (("a", h[1]), ("a", h[1]), ("b", h[0]))) + "]"
    assert got["t"] == (sha("runloom.lineage.v1", text), 3) and got["u"] == (None, 1)


TASK = "plan_id string, task_id string, parameters string, schema_version int, plugin_ref struct<kind:string,plugin_id:string,api_version:int>, operation_id string, operation_api_version int, resources struct<cpu_cores:int,memory_bytes:bigint,gpu_count:int>, retry_policy struct<max_attempts:int,backoff_seconds:double>, restart_safety string, cache_policy string"
INPUT = "plan_id string, task_id string, port string, ord int, artifact struct<record_id:string,semantic_digest:string>, src_task string, src_port string"
OUTPUT = "plan_id string, task_id string, port string, schema_id string, schema_version int, profile_id string, profile_version int, count int"


@pytest.fixture
def plan(spark):
    base = {
        "tasks": [("p", t, '{"b": 1, "a": 2}', 1, ("k", "x", 1), "op", 1, (1, None, 0), (3, 5.0), "restartable", "auto") for t in ("t2", "t1")],
        "inputs": [("p", "t2", "in", 1, None, "t1", "out"), ("p", "t2", "in", 2, ("r1", None), None, None), ("p", "t2", "also", 1, ("r2", "d"), None, None)],
        "outputs": [("p", "t1", "out", "s", 1, None, None, 1), ("p", "t1", "a", "s", 1, "f", 2, 1)],
        "externals": [("p", ("r2", "d")), ("p", ("r1", None))],
    }

    def run(shuffle=None, declared=None, **changes):
        rows = {k: list(changes.get(k, v)) for k, v in base.items()}
        for v in rows.values():
            if shuffle is not None:
                random.Random(shuffle).shuffle(v)
        frames = [spark.createDataFrame(rows[k], s) for k, s in (("tasks", TASK), ("inputs", INPUT), ("outputs", OUTPUT), ("externals", "plan_id string, artifact struct<record_id:string,semantic_digest:string>"))]
        said = None if declared is None else spark.createDataFrame([("p", declared)], "plan_id string, plan_digest string")
        out = D.workflow_plan_digest(*frames, said).collect()
        return [(r.plan_digest, r.n_tasks, r.verified) for r in out] if declared or not out else out[0].plan_digest

    run.base = base
    return run


def test_whole_plans(plan):
    base = plan.base
    ref = lambda r: {"record_id": r[0], "semantic_digest": r[1]}
    task = lambda name, inputs, outputs: {
        "schema_id": D.TASK_SCHEMA, "task_id": name, "schema_version": 1, "plugin_ref": {"kind": "k", "plugin_id": "x", "api_version": 1}, "operation_id": "op", "operation_api_version": 1, "resources": {"cpu_cores": 1, "memory_bytes": None, "gpu_count": 0},
        "retry_policy": {"max_attempts": 3, "backoff_seconds": 5.0}, "restart_safety": "restartable", "cache_policy": "auto", "semantic_parameters": {"a": 2, "b": 1}, "inputs": inputs, "outputs": outputs,
    }
    made = [{"port": "a", "schema_id": "s", "schema_version": 1, "profile_id": "f", "profile_version": 2, "count": 1}, {"port": "out", "schema_id": "s", "schema_version": 1, "profile_id": None, "profile_version": None, "count": 1}]
    inputs = {"in": [{"kind": "output", "task_id": "t1", "port": "out"}, {"kind": "artifact", "artifact": ref(("r1", None))}], "also": [{"kind": "artifact", "artifact": ref(("r2", "d"))}]}
    whole = {"schema_id": D.PLAN_SCHEMA, "schema_version": 1, "tasks": [task("t1", {}, made), task("t2", inputs, [])], "external_inputs": [ref(("r1", None)), ref(("r2", "d"))]}
    want = sha("runloom.plan.v1", json.dumps(whole, sort_keys=True, separators=(",", ":")))
    assert {plan(), plan(shuffle=1), plan(shuffle=2)} == {want}
    assert plan(declared=want) == [(want, 2, True)] and plan(declared="other") == [(want, 2, False)]
    swapped = [("p", "t2", "in", 2, None, "t1", "out"), ("p", "t2", "in", 1, ("r1", None), None, None), base["inputs"][2]]
    assert plan(inputs=swapped) not in (want, None)
    assert plan(externals=[]) not in (want, None) and plan(outputs=base["outputs"][:1]) not in (want, None)
    assert plan(tasks=[(*t[:2], "{", *t[3:]) for t in base["tasks"]]) is None
    assert plan(tasks=[]) == []


def test_repeats_are_left_out_without_a_shuffle(spark):
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2)]
    rows = [("s", "a", h[0]), ("s", "a", h[1]), ("s", "b", h[0])] * 20_000 + [("w", "a", "weak"), ("w", "a", h[0]), (None, "a", h[0])]
    df = spark.createDataFrame(rows, "scope string, name string, digest string").repartition(3)
    out = D.scope_digest(df, distinct=True)
    text = lambda *m: "[" + ",".join(f'{{"path":"{p}","kind":"file","digest":"{d}"}}' for p, d in m) + "]"
    got = {r.scope: r.identity.value for r in out.collect()}
    assert got == {"s": sha("runloom.code.v1", text(("a", min(h)), ("a", max(h)), ("b", h[0]))), "w": None, None: sha("runloom.code.v1", text(("a", h[0])))}
    assert D.scope_digest(df).where("scope = 's'").first().identity.value != got["s"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression [scope") == 1, plan


def test_texts_are_those_of_a_variant(spark):
    kind = "s struct<q:string,a:struct<z:array<struct<y:int,x:string>>,c:boolean>,Z:bigint>, d struct<b:double,a:date,m:map<string,int>>"
    rows = [((c, ([(1, c), None, (None, None)], True), 2**62), (v, None, {"b": 1, "a": None})) for c, v in (('"\\/\n\t\x01\x7f é\U0001f600', 1e10), ("", -0.1), (None, 5.0))] + [(None, None), (("", None, None), None)]
    df = spark.createDataFrame(rows, kind)
    for c in ("s", "d"):
        text = D.canonical_text(df, F.col(c))
        assert ("variant" in str(text)) == (c == "d")
        assert df.where(~text.eqNullSafe(F.to_json(F.to_variant_object(c)))).count() == 0
