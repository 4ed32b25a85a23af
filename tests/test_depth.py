"""Deep plans and chains: ten thousand tasks or runs in a row, and the ways for large groups, on small ones."""

from __future__ import annotations

import random

import pytest

from runloom.operators import graphs as G
from runloom.operators import history as H

DEEP = 10_000


def plain_levels(nodes, links):
    level, left = {}, set(links)
    at, front = 0, [t for t in nodes if all(c != t for _, c in left)]
    while front:
        level |= dict.fromkeys(front, at)
        gone = set(front)
        left, freed = {(p, c) for p, c in left if p not in gone}, {c for p, c in left if p in gone}
        at, front = at + 1, [t for t in freed if all(c != t for _, c in left)]
    return {t: level.get(t) for t in nodes}


def plain_blocked(links, state):
    bad = {t for t, s in state.items() if s in ("failed", "blocked")}
    while more := {c for p, c in links if p in bad and state.get(c) in ("pending", "running", "blocked")} - bad:
        bad |= more
    out = {}
    for p, c in sorted(links):
        if p in bad and state.get(c) in ("pending", "running", "blocked"):
            out.setdefault(c, []).append(p)
    return out


def test_a_chain_of_ten_thousand_tasks(spark):
    rows = spark.range(DEEP).selectExpr("'p' AS plan", "id AS task").unionByName(spark.createDataFrame([("q", 0), ("q", 1), ("q", 2)], "plan string, task long"))
    e = spark.range(1, DEEP).selectExpr("'p' AS plan", "id - 1 AS parent", "id AS child").unionByName(spark.createDataFrame([("q", 0, 1), ("q", 1, 0), ("q", 1, 2)], "plan string, parent long, child long"))
    got = {(r.plan, r.task): r.level for r in G.levels(rows, e).collect()}
    assert got == {("p", i): i for i in range(DEEP)} | {("q", i): None for i in range(3)}
    state = rows.selectExpr("plan", "task", "CASE WHEN task = 0 THEN 'failed' ELSE 'pending' END AS state")
    got = {(r.plan, r.task): r.blocked_by for r in G.blocked(e, state).collect()}
    assert got == {("p", i): [i - 1] for i in range(1, DEEP)} | {("q", 1): [0], ("q", 2): [1]}


@pytest.mark.parametrize("limit", [0, 12, 1000])
def test_walked_and_peeled_plans_agree(spark, limit):
    rng = random.Random(7)
    nodes, links, states = [], [], []
    want, stopped = {}, {}
    for plan in range(8):
        n = 4 + plan
        own = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)) if a < b or (plan % 3 == 0 and a != b)}
        state = {t: rng.choice(["pending", "pending", "succeeded", "failed", "running", "blocked"]) for t in range(n)}
        nodes += [(plan, t) for t in range(n)] * 2
        links += [(plan, a, b) for a, b in own] * 2
        states += [(plan, t, s) for t, s in state.items()]
        want |= {(plan, t): v for t, v in plain_levels(range(n), own).items()}
        stopped |= {(plan, t): v for t, v in plain_blocked(own, state).items()}
    n, e = spark.createDataFrame(nodes, "plan long, task long"), spark.createDataFrame(links, "plan long, parent long, child long")
    got = G.levels(n, e, limit).collect()
    assert {(r.plan, r.task): r.level for r in got} == want and len(got) == len(want)
    assert {(r.plan, r.task): r.blocked_by for r in G.blocked(e, spark.createDataFrame(states, "plan long, task long, state string"), limit).collect()} == stopped


def test_no_plans(spark):
    n, e = spark.createDataFrame([], "plan long, task string"), spark.createDataFrame([], "plan long, parent string, child string")
    assert G.levels(n, e).collect() == [] and G.blocked(e, spark.createDataFrame([], "plan long, task string, state string")).collect() == []


def test_a_chain_of_ten_thousand_runs(spark):
    runs = spark.range(DEEP).selectExpr("id AS run_id", "IF(id > 0, id - 1, NULL) AS resume_of", "'s' AS scope_id", "'p' AS plan_digest")
    done = spark.createDataFrame([(3, "a"), (5000, "a"), (9000, "b"), (9999, "b")], "run_id long, task_id string").selectExpr("*", "'succeeded' AS state", "'f' AS fingerprint", "'e' AS execution")
    got = {(r.run_id, r.task_id): r.depth for r in H.adopted_identity(runs, done).collect()}
    want = {(i, "a"): i - 3 if i < 5000 else i - 5000 for i in range(3, DEEP)} | {(i, "b"): i - 9000 if i < 9999 else 0 for i in range(9000, DEEP)}
    assert got == want


def test_chains_that_loop_branch_or_change_scope(spark):
    rows = [(1, None, "s", "p"), (2, 1, "s", "p"), (3, 2, "s", "p"), (4, 2, "s", "p"), (5, 4, "t", "p"), (6, 5, "t", "p"), (7, 8, "s", "p"), (8, 7, "s", "p"), (9, 8, "s", "p"), (10, 99, "s", "p"), (11, 11, "s", "p"), (12, 10, "s", None), (13, None, None, None), (14, 13, None, None)]
    runs = spark.createDataFrame(rows, "run_id long, resume_of long, scope_id string, plan_digest string")
    done = [(1, "a", "succeeded"), (3, "a", "failed"), (4, "a", "succeeded"), (8, "a", "succeeded"), (10, "a", "succeeded"), (11, "a", "succeeded"), (13, "a", "succeeded"), (1, "b", "succeeded"), (5, "c", "succeeded"), (77, "a", "succeeded")]
    resolutions = spark.createDataFrame([(r, t, s, f"f{r}", f"e{r}") for r, t, s in done], "run_id long, task_id string, state string, fingerprint string, execution string")
    got = {(r.run_id, r.task_id): (r.fingerprint, r.execution, r.depth) for r in H.adopted_identity(runs, resolutions).collect()}
    assert got == {
        (1, "a"): ("f1", "e1", 0), (1, "b"): ("f1", "e1", 0), (2, "a"): ("f1", "e1", 1), (2, "b"): ("f1", "e1", 1), (3, "a"): ("f1", "e1", 2), (3, "b"): ("f1", "e1", 2), (4, "a"): ("f4", "e4", 0), (4, "b"): ("f1", "e1", 2),
        (10, "a"): ("f10", "e10", 0), (13, "a"): ("f13", "e13", 0), (14, "a"): ("f13", "e13", 1),
    }
    assert H.adopted_identity(runs.limit(0), resolutions).collect() == [] and H.adopted_identity(runs, resolutions.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_timeline_of_one_busy_host(spark, parts):
    rng = random.Random(8)
    rows = [(h, s, None if rng.random() < 0.2 else s + rng.randrange(1, 9), rng.randrange(1, 4)) for h in [*["busy"] * 300, "idle", None] for s in [rng.randrange(40)]]
    attempts = spark.createDataFrame(rows, "host string, s long, f long, cpu long")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.host, r["at"], r.step): r.cpu_running for r in G.resource_timeline(attempts, ["host"], "s", "f", ["cpu"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    steps = sorted({(h, s, 1) for h, s, _, _ in rows} | {(h, f, 0) for h, _, f, _ in rows if f is not None}, key=lambda x: (x[0] or "", x[1], x[2]))
    want = {(h, t, k): sum(c for g, s, f, c in rows if g == h and (s, 1) <= (t, k)) - sum(c for g, s, f, c in rows if g == h and f is not None and (f, 0) <= (t, k)) for h, t, k in steps}
    assert got == want


def test_what_plans_come_from_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("p", 1), ("p", 2), ("p", 2), (None, 1), (None, 2), (None, 3), ("q", 1), ("q", 2), ("q", 3), ("q", 4)]
    nodes = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: seen.add(1) or r), "plan string, task int")
    e = spark.createDataFrame([("p", 1, 2), (None, 1, 2), (None, 2, 3)], "plan string, parent int, child int")
    got = {(r.plan, r.task): r.level for r in G.levels(nodes, e).collect()}
    assert got == {("p", 1): 0, ("p", 2): 1, (None, 1): 0, (None, 2): 1, (None, 3): 2, **{("q", i): 0 for i in range(1, 5)}}
    assert seen.value == len(rows)
    # a null plan is walked whatever its size; the larger one is peeled, between two that are walked
    assert {(r.plan, r.task): r.level for r in G.levels(nodes.repartition(1), e, limit=3).collect()} == {k: v for k, v in got.items() if k[0] != "p"} | {("p", 1): 0, ("p", 2): 1}
