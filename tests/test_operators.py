"""Operators on small hand-made tables: codes, order, permutations, metamorphic digests."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions import digests as D
from runloom.functions import exprs as X
from runloom.operators import config as C
from runloom.operators import graphs as G
from runloom.operators import history as H
from runloom.operators import integrity, issues, products, reuse, secrets
from runloom.sources import records
from runloom.streaming import live

GOOD = "a" * 64


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, tuple) else v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] if isinstance(v, tuple) else v for v in values.values())], schema).select(column.alias("x")).first().x


def codes(df):
    return sorted((r.subject_id, r.code) for r in df.collect())


# expressions


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.is_identifier, "ab-c", True), (X.is_identifier, "a b", False), (X.is_identifier, "", False), (X.is_identifier, "a​", False),
    (X.is_digest, GOOD, True), (X.is_digest, GOOD + "\n", False), (X.is_digest, GOOD.upper(), False),
    (X.is_namespaced, "a:b", True), (X.is_namespaced, "a:b:c", False), (X.is_namespaced, ":b", False), (X.is_namespaced, "flag", False),
    (X.is_secret_key, "X-Api.Key", True), (X.is_secret_key, "name", False),
    (X.has_secret_value, "-----BEGIN RSA PRIVATE KEY-----", True), (X.has_secret_value, "https://u@h/x", True), (X.has_secret_value, "https://h/x?sig=1", True), (X.has_secret_value, "https://h/x?a=1;to%6ben", True), (X.has_secret_value, "x?sig=1", False),
    (X.path_ok, "a/b", True), (X.path_ok, "C:x", False), (X.path_ok, "$HOME/x", False), (X.path_ok, "//x", False), (X.path_ok, "~x", False), (X.path_ok, "", False),
    (X.member_path_ok, "a/b", True), (X.member_path_ok, "a/../b", False), (X.member_path_ok, "/a", False), (X.member_path_ok, " a", False),
    (X.iso_date, "20240229", "2024-02-29"), (X.iso_date, "20230229", None), (X.iso_date, "2024-2-9", None), (X.iso_date, "2024-02-09", "2024-02-09"),
    (X.label_ok, "a", True), (X.label_ok, " ", False), (X.label_ok, "a\nb", False), (X.label_ok, "a" * 129, False),
])
def test_expressions(spark, f, value, want):
    assert one(spark, f(F.col("v")), v=value) == want


@pytest.mark.parametrize(("path", "want"), [("x", "/b/x"), ("../x", "/x"), ("/a/./b/../c//d", "/a/c/d"), ("../../..", "/"), (".", "/b")])
def test_lexical_abspath(spark, path, want):
    assert one(spark, X.lexical_abspath(F.col("v"), "/b"), v=path) == want


def test_fingerprints_hold_a_digest_or_reasons(spark):
    reasons = ("array<string>",)
    f = lambda v, r: one(spark, X.fingerprint_struct(F.col("v"), F.col("r")), v=v, r=(r, *reasons)).asDict()
    assert f(GOOD, []) == {"value": GOOD, "reusable": True, "reasons": []}
    assert f(GOOD, ["B", "A", "B"]) == {"value": None, "reusable": False, "reasons": ["A", "B"]}


# digests


def test_domain_digest_matches_plain_sha(spark):
    text = json.dumps({"a": 1, "b": None}, separators=(",", ":"))
    got = one(spark, D.domain_digest("dom", D.canonical(b=F.lit(None).cast("string"), a=F.lit(1))), v="x")
    assert got == hashlib.sha256(b"dom\0" + text.encode()).hexdigest()


def test_input_order_and_repeats_change_the_identity(spark):
    def identity(rows):
        df = spark.createDataFrame([("t", *r) for r in rows], "task string, port string, ord int, semantic_digest string")
        return D.input_identities(df.repartition(3), ["task"]).first()

    a, b = "a" * 64, "b" * 64
    base = identity([("p", 0, a), ("p", 1, b)])
    assert base.strong and identity([("p", 1, b), ("p", 0, a)]).inputs == base.inputs
    assert identity([("p", 0, b), ("p", 1, a)]).inputs != base.inputs
    assert identity([("p", 0, a), ("p", 1, b), ("p", 2, b)]).inputs != base.inputs
    assert identity([("p", 0, a), ("p", 1, None)]).inputs is None


def test_recipe_ignores_what_it_is_not_made_of(spark):
    def recipe(**change):
        row = {"task": "t", "operation": "o", "execution": GOOD, "retry": 1} | change
        df = spark.createDataFrame([tuple(row.values())], "task string, operation string, execution string, retry int").withColumn("inputs", F.array(F.lit("x")))
        return D.task_recipe(df, ["task"], ["operation"], {"execution": "EXECUTION_WEAK"}).first().recipe

    base = recipe()
    assert recipe(task="other", retry=9).value == base.value
    assert recipe(operation="p").value != base.value
    weak = recipe(execution="weak")
    assert weak.value is None and weak.reasons == ["EXECUTION_WEAK"]


# integrity


MEMBERS = "dir_id string, path string, member_kind string, size_bytes long, algorithm string, digest string"
SEEN = "dir_id string, path string, kind string, size_bytes long, sha256 string"


@pytest.mark.parametrize(("members", "seen", "want"), [
    ([], [], []),
    ([("d", "f", "file", 1, "sha256", GOOD)], [("d", "f", "file", 1, GOOD)], []),
    ([("d", "y", "file", 1, "sha256", GOOD)], [("d", "x", "file", 1, GOOD)], ["member-missing", "member-unexpected"]),
    ([("d", "f", "file", 2, "sha256", "zz")], [("d", "f", "file", 1, GOOD)], ["member-invalid-sha256"]),
    ([("d", "f", "file", 2, "sha256", "b" * 64)], [("d", "f", "file", 1, GOOD)], ["member-integrity-mismatch", "member-size-mismatch"]),
    ([("d", "f", "file", 1, "md5", "x")], [("d", "f", "file", 1, GOOD)], ["member-integrity-unverified"]),
    ([("d", "f", "file", 1, "SHA256", GOOD.upper())], [("d", "f", "file", 1, GOOD)], []),
    ([("d", "f", "directory", None, None, None)], [("d", "f", "file", 1, GOOD)], ["member-kind-mismatch"]),
])
def test_directory(spark, members, seen, want):
    found = integrity.reconcile_directory(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(seen, SEEN))
    assert sorted(r.code for r in found.collect()) == want


def test_suppression_below_prefixes(spark):
    found = spark.createDataFrame([("d", "error", "member-missing", "a/b/c"), ("d", "error", "member-missing", "ab/c"), ("d", "error", "member-unexpected", "o/x"), ("d", "error", "member-unexpected", "o")], issues.SCHEMA)
    uncertain = spark.createDataFrame([("d", "a")], "dir_id string, prefix string")
    opaque = spark.createDataFrame([("d", "o")], "dir_id string, path string")
    left = integrity.suppress_uncertain(found, uncertain, opaque)
    assert sorted(r.location for r in left.collect()) == ["ab/c", "o"]


# graphs


def graph(spark, nodes, edges):
    n = spark.createDataFrame([("p", x) for x in nodes], "plan string, task string")
    return n, spark.createDataFrame([("p", a, b) for a, b in edges], "plan string, parent string, child string")


@pytest.mark.parametrize(("nodes", "edges", "want"), [
    ("abc", [("a", "b"), ("b", "c")], "abc"), ("abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "abcd"), ("zam", [("z", "a")], "mza"), ("ab", [("a", "b"), ("b", "a")], ""), ("eabc", [("e", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "e"),
])
def test_topological_order(spark, nodes, edges, want):
    n, e = graph(spark, nodes, edges)
    rows = G.topological_order(n.repartition(3), e.repartition(2)).orderBy("place").collect()
    assert "".join(r.task for r in rows) == want
    assert {r.task for r in G.cycles(G.levels(n, e)).collect()} == set(nodes) - set(want)


def test_structure_codes(spark):
    tasks = spark.createDataFrame([("dup", "a"), ("dup", "a"), ("self", "a"), ("lost", "a"), ("port", "a"), ("port", "b"), ("ext", "a")], "plan_id string, task_id string")
    inputs = spark.createDataFrame([("self", "a", "i", 0, "a", "o", None), ("lost", "a", "i", 0, "zz", "o", None), ("port", "b", "i", 0, "a", "bad", None), ("ext", "a", "i", 0, None, None, "r1")], "plan_id string, task_id string, port string, ord int, src_task string, src_port string, artifact string")
    outputs = spark.createDataFrame([("self", "a", "o"), ("port", "a", "o")], "plan_id string, task_id string, port string")
    externals = spark.createDataFrame([("ext", "x", "r1"), ("ext", "x", "r2")], "plan_id string, record_id string, reference string")
    assert codes(G.check_structure(tasks, inputs, outputs, externals)) == [("dup", "PLAN_DUPLICATE_TASK"), ("ext", "PLAN_CONFLICTING_EXTERNAL"), ("ext", "PLAN_EXTERNAL_SET"), ("lost", "PLAN_UNKNOWN_TASK"), ("port", "PLAN_UNKNOWN_PORT"), ("self", "PLAN_SELF_REFERENCE")]


def test_blocking_spares_independent_branches(spark):
    _, e = graph(spark, "", [("a", "b"), ("b", "c")])
    states = spark.createDataFrame([("p", "a", "failed"), ("p", "b", "pending"), ("p", "c", "pending"), ("p", "z", "pending")], "plan string, task string, state string")
    assert sorted((r.task, r.blocked_by) for r in G.blocked(e, states).collect()) == [("b", ["a"]), ("c", ["b"])]
    assert [r.task for r in G.ready(e, states, 0.0).collect()] == ["z"]


# history and reuse


def test_retry_matrix(spark):
    rows = [("r", "failed", True), ("f", "failed", False), ("i", "interrupted", False), ("s", "succeeded", False)]
    attempts = spark.createDataFrame([("run", t, 1, o, r, 10.0, None) for t, o, r in rows], "run_id string, task_id string, sequence int, outcome string, retryable boolean, ended_at double, error_code string")
    for restartable in (True, False):
        for budget in (1, 3):
            policy = spark.createDataFrame([(t, budget, restartable, 5.0) for t, _, _ in rows], "task_id string, max_attempts int, restartable boolean, backoff double")
            d = H.retry_decision(attempts, policy, ["run_id", "task_id"])
            assert {r.task_id for r in d.where("retry").collect()} == ({"r", "i"} if restartable and budget == 3 else set())
            assert all(r.ready_at == 15.0 for r in H.next_ready(d).collect())


def test_resume_chain_stops_at_loops_and_changed_plans(spark):
    runs = spark.createDataFrame([("a", None, "s", "p"), ("b", "a", "s", "p"), ("c", "b", "s", "p"), ("x", "y", "s", "p"), ("y", "x", "s", "p"), ("q", "a", "s", "other")], "run_id string, resume_of string, scope_id string, plan_digest string")
    done = spark.createDataFrame([("a", "t", "succeeded", "fa", "e"), ("b", "t", "succeeded", "fb", "e"), ("a", "u", "succeeded", "fu", "e"), ("x", "t", "succeeded", "fx", "e")], "run_id string, task_id string, state string, fingerprint string, execution string")
    got = {(r.run_id, r.task_id): (r.fingerprint, r.depth) for r in H.adopted_identity(runs, done).collect()}
    assert got == {("a", "t"): ("fa", 0), ("a", "u"): ("fu", 0), ("b", "t"): ("fb", 0), ("b", "u"): ("fu", 1), ("c", "t"): ("fb", 1), ("c", "u"): ("fu", 2)}


def test_first_reject_reason_wins(spark):
    assert one(spark, reuse.first_reason([("A", F.lit(False)), ("B", F.lit(None).cast("boolean")), ("C", F.lit(True)), ("D", F.lit(True))]), v="x") == "CACHE_C"


def test_cardinality_counts_zero_members(spark):
    p = spark.createDataFrame([("x", "p", 1), ("y", "p", 1)], "product_id string, profile_id string, profile_version int")
    r = spark.createDataFrame([("p", 1, "need", ["file"], 1, 2)], "profile_id string, profile_version int, requirement_id string, allowed_kinds array<string>, min_count int, max_count int")
    m = spark.createDataFrame([("x", "file"), ("x", "directory"), ("y", "directory")], "product_id string, asset_kind string")
    assert codes(products.check_cardinality(p, r, m, products.asset_matches(), "asset-requirement-unsatisfied")) == [("y", "asset-requirement-unsatisfied")]


# settings


BASE = {"schema_version": 1, "data": {"search": {"longitude": 0, "latitude": 0}}}
DOCS = {
    "manual": BASE | {"workflow": {"pair": {"selection": "manual", "reference_date": "2025-01-01", "secondary_date": "20250113"}}},
    "event": BASE | {"workflow": {"pair": {"selection": "event", "event_date": "2025-01-07"}}},
    "stack": BASE | {"workflow": {"type": "stack", "stack": {"start_date": "2023-01-01", "end_date": "2023-03-01"}}},
}


def test_minimal_documents_resolve(spark):
    none = spark.createDataFrame([], "config_id string, path string, value_json string")
    base = spark.createDataFrame([(k, "/cfg") for k in DOCS], "config_id string, base string")
    out = C.resolve(C.leaves_of(spark, DOCS), none, base, C.rules(spark))
    assert out["issues"].count() == 0
    got = {(r.config_id, r.path): (r.value_json, r.origin) for r in out["resolved"].collect()}
    assert got["manual", "workflow.pair.secondary_date"] == ('"2025-01-13"', "yaml")
    assert got["event", "workflow.pair.half_window_days"] == ("12", "profile_default")
    assert got["stack", "data.paths.slc_dir"] == ('"/cfg/SLC"', "derived")
    assert got["manual", "processing.roi.half_width_deg"] == ("0.2", "derived")
    assert ("stack", "outputs.pair.phase_products") not in got
    assert [(r.config_id, r.path, r.rule) for r in out["normalizations"].collect()] == [("manual", "workflow.pair.secondary_date", "date_iso")]


def test_bad_values_have_codes(spark):
    bad = {"project.name": " ", "mission.platform": "ALOS-2", "data.search.half_width_deg": -1, "data.catalog.request_size": 0, "data.paths.slc_dir": "C:slc", "processing.isce2.pair.swaths": [1, 1], "processing.isce2.pair.unwrap": "true", "corrections": ["x"], "resources.num_proc": True, "outputs.stack_advice.enabled": True, "x.y": 1, "workflow.pair.reference_date": 20241231}
    leaves = C.leaves_of(spark, {"m": DOCS["manual"]}).where(~F.col("path").isin(*bad))
    rows = spark.createDataFrame([("m", p, json.dumps(v)) for p, v in bad.items()], "config_id string, path string, value_json string")
    found = C.check_leaves(leaves.unionByName(rows), C.select_profile(leaves), C.rules(spark))
    assert {r.location: r.code for r in found.collect()} == {
        "project.name": "CONFIG_RANGE", "mission.platform": "CONFIG_RANGE", "data.search.half_width_deg": "CONFIG_RANGE", "data.catalog.request_size": "CONFIG_RANGE", "data.paths.slc_dir": "CONFIG_PATH", "processing.isce2.pair.swaths": "CONFIG_RANGE",
        "processing.isce2.pair.unwrap": "CONFIG_TYPE", "corrections": "CONFIG_UNSUPPORTED", "resources.num_proc": "CONFIG_TYPE", "outputs.stack_advice.enabled": "CONFIG_CONFLICT", "x.y": "CONFIG_UNKNOWN_KEY", "workflow.pair.reference_date": "CONFIG_TYPE",
    }


# secrets, sources, streams


def test_secret_scans(spark):
    docs = spark.createDataFrame([(1, '{"a":{"pass_word":1}}'), (2, '{"authentication_required":true}'), (3, '{"a":["https:\\/\\/u@h"]}'), (4, "{}"), (5, None)], "i long, j string")
    assert codes(secrets.scan_nested(docs, "i", "j")) == [("1", "secret-key"), ("3", "secret-value")]
    lines = spark.createDataFrame([(1, "ok\r\n  api-key: x\nthe token = 1")], "i long, t string")
    assert [r.location for r in secrets.scan_lines(lines, "i", "t").collect()] == ["2"]
    assert sorted(r.location for r in secrets.scan_lines(lines, "i", "t", anchored=False).collect()) == ["2", "3"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in/runs/r1/transitions").mkdir(parents=True)
    (tmp_path / "in/runs/r1/run.json").write_text('{"run_id":"r1","n":1}')
    fact = {"schema_version": 2, "kind": "transition", "payload": {"task_id": "t", "state": "running"}}
    broken = [fact | {"schema_version": 1}, fact | {"schema_version": True}, fact | {"kind": "run"}, fact | {"more": 1}, fact | {"payload": {"task_id": "t"}}]
    for n, x in enumerate([fact, *broken]):
        (tmp_path / f"in/runs/r1/transitions/{n}.json").write_text(json.dumps(x))
    facts, refused = records.read_facts(spark, f"file://{tmp_path}/in", "transition")
    assert [(r.path_ids, r.task_id, r.state, r.path_ok) for r in facts.collect()] == [(["r1", "0"], "t", "running", True)]
    assert sorted(r.reject_code for r in refused.collect()) == ["RECORD_FIELDS"] * 2 + ["RUNTIME_RECORD_VERSION_UNSUPPORTED"] * 3
    schema = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("n", T.LongType())])
    good, rejects = records.read_records(spark, f"file://{tmp_path}/in", schema)
    assert good.count() == 1 and rejects.count() == 6
    seen = {r.path: (r.size_bytes, r.sha256) for r in records.read_inventory(spark, f"file://{tmp_path}/in").collect()}
    assert seen["runs/r1/run.json"] == (21, hashlib.sha256(b'{"run_id":"r1","n":1}').hexdigest())
    df = spark.range(3).withColumnRenamed("id", "k")
    records.write_resolved(df, f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="exist"):
        records.write_resolved(df, f"file://{tmp_path}/out")
    ok, refused = records.append_facts(df.unionByName(df.limit(1)), spark.range(2, 3).withColumnRenamed("id", "k"), ["k"])
    assert sorted(r.k for r in ok.collect()) == [0, 1] and sorted(r.k for r in refused.collect()) in ([0, 2], [1, 2], [2, 2])


def test_stream_ignores_repeated_files(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    steps = ["pending", "running", "succeeded", "running"]
    rows = spark.createDataFrame([("r", "t", i, s) for i, s in enumerate(steps)], live.TRANSITION)

    def feed(name, part):
        part.coalesce(1).write.json(f"{tmp_path}/in/{name}")
        q = live.live_state(live.read_transitions(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()

    feed("a", rows.where("event_no < 2"))
    feed("b", rows)
    got = [(r.event_no, r.state, r.violation) for r in spark.read.schema(live.LIVE).parquet(f"{tmp_path}/out").orderBy("event_no").collect()]
    assert got == [(0, "pending", None), (1, "running", None), (2, "succeeded", None), (3, "running", "succeeded>running")]


def test_failing_user_checks_leave_subjects_unverified(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")

    def broken(_):
        raise RuntimeError("secret payload")

    found = issues.apply_checks(df, "k", {"broken": broken}).collect()
    assert [(r.code, r.location) for r in found] == [("CHECK_FAILED", "broken")]
    assert all(r.is_valid and not r.is_fully_verified for r in issues.verified_by(df, "k", {"broken": broken}).collect())


def test_long_chains_are_followed_to_their_end(spark):
    n = 9
    nodes = spark.createDataFrame([("p", i) for i in range(n)] + [("q", 0), ("q", 1)], "plan string, task int")
    e = spark.createDataFrame([("p", i, i + 1) for i in range(n - 1)] + [("q", 0, 1), ("q", 1, 0)], "plan string, parent int, child int")
    assert {(r.plan, r.task, r.level) for r in G.levels(nodes, e).collect()} == {("p", i, i) for i in range(n)} | {("q", 0, None), ("q", 1, None)}
    states = nodes.withColumn("state", F.when(F.col("task") == 0, "failed").otherwise("pending"))
    assert {(r.plan, r.task) for r in G.blocked(e, states).collect()} == {("p", i) for i in range(1, n)} | {("q", 1)}


def test_escaped_secret_keys_are_found(spark):
    docs = [(1, '{"\\u0070assword":"x"}'), (2, '{"a":"https:\\/\\/u:p@h"}'), (3, '{"a":"b\\n\\u0041"}'), (4, '{"authentication_required":true}')]
    assert codes(secrets.scan_nested(spark.createDataFrame(docs, "id int, doc string"), "id", "doc")) == [("1", "secret-key"), ("2", "secret-value")]


def test_a_check_that_fails_while_it_runs_is_a_safe_code(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "1")], "id string, v string")
    good = lambda df: df.where("id = 'a'").select(F.col("id").alias("subject_id"), F.lit("error").alias("kind"), F.lit("bad").alias("code"), F.lit("v").alias("location"))
    late = lambda df: df.select(F.raise_error(F.lit("secret message")).cast("string").alias("subject_id"), F.lit("error").alias("kind"), F.lit("x").alias("code"), F.lit("y").alias("location"))
    found = issues.apply_checks(rows, "id", {"good": good, "late": late}).collect()
    assert sorted((r.subject_id or "", r.kind, r.code, r.location) for r in found) == [("", "unverified", "CHECK_FAILED", "late"), ("a", "error", "bad", "v")]


def test_few_rules_are_not_joined_by_their_keys(spark, capsys):
    """All products of one profile would else be dealt to one task."""
    from runloom.operators import products as P

    rules = spark.createDataFrame([("p", 1, "r", 1, 1, ["file"])], "profile_id string, profile_version int, requirement_id string, min_count int, max_count int, allowed_kinds array<string>")
    made = spark.createDataFrame([(i, "p", 1) for i in range(3)], "product_id long, profile_id string, profile_version int")
    members = spark.range(2).selectExpr("id AS product_id", "'file' AS asset_kind")
    found = P.check_cardinality(made, rules, members, P.asset_matches(), "c")
    assert [(r.subject_id, r.observed_count) for r in found.collect()] == [("2", 0)]
    found.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin [profile_id" in plan, plan


def test_structure_is_checked_in_as_many_partitions_as_there_are(spark, capsys):
    """Ports that nothing names, and those of no plan, are told apart as before; no exchange may be joined to a few partitions."""
    from runloom.operators import graphs as G

    tasks = spark.createDataFrame([("p", 1), ("p", 2), (None, 1)], "plan_id string, task_id int")
    outputs = spark.createDataFrame([("p", 1, None), ("p", 1, None), ("p", 2, "x"), (None, 1, "x"), ("p", 9, "x")], "plan_id string, task_id int, port string")
    inputs = spark.createDataFrame([("p", 2, "x", 1, "y"), ("p", 2, None, 9, "x"), ("p", 1, "z", 2, "x"), (None, 2, "x", 1, "x"), ("p", 1, "in", None, None)], "plan_id string, task_id int, port string, src_task int, src_port string")
    found = G.check_structure(tasks, inputs.withColumn("artifact", F.lit("a")), outputs)
    assert sorted((r.subject_id or "", r.code, r.location) for r in found.collect()) == [
        ("", "PLAN_UNKNOWN_TASK", "2"), ("p", "PLAN_DUPLICATE_PORT", "1"), ("p", "PLAN_DUPLICATE_PORT", "2"), ("p", "PLAN_UNKNOWN_PORT", "2"), ("p", "PLAN_UNKNOWN_TASK", "2"),
    ]
    found.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "AQEShuffleRead coalesced" not in plan, plan


def dealt_plan(found, capsys):
    """The plan of a query that ran: no exchange may be joined to a few partitions, whose memory would grow with the input."""
    found.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "AQEShuffleRead coalesced" not in plan, plan


def test_lineage_is_checked_in_as_many_partitions_as_there_are(spark, capsys):
    rows = spark.createDataFrame([("p", "r", "a", "x"), ("p", "r", "a", "x"), ("p", "r", "a", None), ("p", "r", "b", "x"), ("p", "r", "b", "y"), (None, None, "b", "x"), (None, None, "b", "y")], "product_id string, role string, record string, reference string")
    found = products.check_lineage(rows, "product_id", "role", "record", F.col("reference"))
    assert sorted((r.subject_id or "", r.code, r.location) for r in found.collect()) == [("", "lineage-conflict", "b"), ("p", "lineage-conflict", "r:b")]
    dealt_plan(found, capsys)


def test_members_are_counted_in_as_many_partitions_as_there_are(spark, capsys):
    rules = spark.createDataFrame([("p", 1, "r", 1, 1, ["file"])], "profile_id string, profile_version int, requirement_id string, min_count int, max_count int, allowed_kinds array<string>")
    made = spark.createDataFrame([(i, "p", 1) for i in range(3)], "product_id long, profile_id string, profile_version int")
    members = spark.createDataFrame([(0, "file"), (1, "file"), (1, "file"), (2, "dir")], "product_id long, asset_kind string")
    found = products.check_cardinality(made, rules, members, products.asset_matches(), "c")
    assert sorted((r.subject_id, r.observed_count) for r in found.collect()) == [("1", 2), ("2", 0)]
    dealt_plan(found, capsys)


def test_layers_are_checked_in_as_many_partitions_as_there_are(spark, capsys):
    reference = lambda status, **fields: F.struct(F.lit(status).alias("status"), *[v.alias(k) for k, v in fields.items()])
    layers = spark.createDataFrame([("p", "l1", "a"), ("p", "l2", "x"), ("p", "l3", None), (None, "l4", "a")], "product_id string, layer_id string, asset_id string")
    layers = layers.select("*", reference("known", value=F.lit("g")).alias("geometry_ref"), reference("known", value=F.struct(F.lit("mask").alias("kind"), F.when(F.col("layer_id") == "l1", "zz").otherwise("l1").alias("mask_layer_ref"))).alias("nodata"))
    assets = spark.createDataFrame([("p", "a"), ("p", "a"), (None, "a")], "product_id string, asset_id string")
    found = products.check_layers(layers, assets, spark.createDataFrame([("p", "g")], "product_id string, geometry_id string"))
    assert sorted((r.subject_id or "", r.code, r.location) for r in found.collect()) == [
        ("", "missing-asset-reference", "l4"), ("", "missing-geometry-reference", "l4"), ("", "missing-mask-layer-reference", "l4"), ("p", "missing-asset-reference", "l2"), ("p", "missing-mask-layer-reference", "l1"),
    ]
    found.explain()
    assert "LeftAnti" not in capsys.readouterr().out  # which would be pushed below the dealing


def test_inputs_are_grouped_once(spark, capsys):
    """Rows that are dealt by their group are not shuffled again by port; ports are told apart, also the one without a name."""
    a, b, c = (x * 64 for x in "abc")
    rows = [("t", "q", 2, a), ("t", "p", 1, b), ("t", None, 1, c), ("t", "q", 1, b), ("t", "q", 1, b), ("t", "r", None, a), ("u", "p", 1, a), ("v", "p", 1, a), ("v", "q", 1, "weak")]
    df = spark.createDataFrame(rows, "task string, port string, ord int, semantic_digest string").repartition("task")
    found = D.input_identities(df, ["task"], also=[F.count("*").alias("n")])
    assert {r.task: (r.strong, r.n, r.inputs and [(i.port, i.semantic_digests) for i in r.inputs]) for r in found.collect()} == {
        "t": (True, 6, [(None, [c]), ("p", [b]), ("q", [b, b, a]), ("r", [a])]), "u": (True, 1, [("p", [a])]), "v": (False, 2, None),
    }
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_documents_are_explained_in_one_pass(spark, capsys):
    """The same rows as step after step, without a join by path; a document without a profile or a folder has none."""
    odd = {"project": {"work_dir": "../w//x/."}, "data": {"provider": "cdse", "paths": {"slc_dir": "../s", "dem_dir": None}}, "mission": {"platform": "S1A"}, "processing": {"roi": {"half_width_deg": None}}, "zz": 1, "resources": {"num_proc": None}}
    docs = DOCS | {"odd": DOCS["manual"] | odd, "wide": DOCS["stack"] | {"data": {"search": {"longitude": 1, "latitude": 2, "half_width_deg": 3}, "catalog": {"timeout_seconds": 7}}}, "none": {"schema_version": 2}, "homeless": DOCS["event"]}
    leaves, table = C.leaves_of(spark, docs).repartition(3, "config_id"), C.rules(spark)
    base = spark.createDataFrame([(k, "/cfg/" + k) for k in docs if k != "homeless"], "config_id string, base string").repartition(3, "config_id")
    full, _ = C.fill_defaults(C.canonical_leaves(leaves).withColumn("origin", F.lit("yaml")), C.select_profile(leaves), table)
    resolved = C.derive_fields(full, base)
    audit = C.audit_normalizations(leaves, resolved)
    rows = C.explained(leaves, base, table)
    plain = lambda df: sorted(map(str, df.collect()))
    own = rows.where("NOT deferred")
    assert plain(own.select(*resolved.columns)) == plain(resolved) and own.where("config_id = 'odd'").count() > 40
    assert plain(rows.where("rule IS NOT NULL").select("config_id", "path", "rule")) == plain(audit) and audit.count() > 3
    told = rows.select("config_id", "path", "origin", F.array_join("dependencies", ",").alias("dependencies"), F.coalesce("rule", F.lit("")).alias("rules"))
    assert plain(told) == plain(C.explain(resolved, audit))
    rows.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(config_id") == plan.count("REPARTITION_BY_NUM") == 2, plan
