"""Run history: append-only facts to attempts, retries, recovery, terminal states and run status.

Fact tables (columns used): ``runs`` run_id, scope_id, resume_of, plan_digest; ``started`` run_id,
scope_id, task_id, attempt_id, sequence, plan_digest, fingerprint, execution, started_at; ``finished``
attempt_id, outcome, error_code, retryable, ended_at, receipt; ``receipts`` attempt_id, task_id,
scope_id, fingerprint, execution, outputs; ``resolutions`` run_id, task_id, state, disposition, error_code,
fingerprint, execution; ``summaries`` / ``recoveries`` run_id, status; ``transitions`` run_id, task_id,
event_no, state.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.exprs import is_digest, path_key
from runloom.operators.issues import ERROR, all_issues, issue
from runloom.sources.shared import checkpointed

# Allowed task transitions, and error codes by cause.
TRANSITIONS = (("pending", "succeeded"), ("pending", "running"), ("pending", "failed"), ("pending", "blocked"), ("running", "succeeded"), ("running", "pending"), ("running", "failed"))
TERMINAL = ("succeeded", "failed", "blocked")
ERROR_CODES = {"retryable": "EXECUTION_RETRYABLE", "contract": "CONTRACT_INVALID", "output": "OUTPUT_INVALID", "interrupted": "INTERRUPTED"}
OTHER_ERROR = "EXECUTION_FAILED"


RETRYABLE = "EXECUTION_RETRYABLE"
# States, outcomes and codes that facts may hold.
STATES = ("pending", "running", "succeeded", "failed", "blocked")
ATTEMPT_CODES = (RETRYABLE, OTHER_ERROR, "CONTRACT_INVALID", "OUTPUT_INVALID", "INTERRUPTED")
RESOLUTION_CODES = ("UPSTREAM_FAILED", "RESTART_FORBIDDEN", "PREFLIGHT_FAILED", *ATTEMPT_CODES)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _is_text(c: Column) -> Column:
    return _sure(c != "")


def _is_key(c: Column) -> Column:
    return _sure(c.rlike(r"\A[0-9a-f]{32}\z"))


def _weak_or(c: Column) -> Column:
    return c.isNull() | _sure(is_digest(c))


def _is_moment(c: Column) -> Column:
    return _sure((c >= 0) & (c < float("inf")) & ~F.isnan(c))


def _identity_ok(c: Column) -> Column:
    return _sure(_weak_or(c["value"]) & (c["reusable"] == c["value"].isNotNull()) & F.forall(c["reasons"], _is_text))


def _input_rules() -> list[tuple[str, str, Column]]:
    """Rules of recorded inputs: (code, field, what must hold)."""
    inputs = F.col("inputs")
    ports = F.transform(inputs, lambda i: i["port"])
    whole = F.forall(inputs, lambda i: _is_text(i["port"]) & _sure(F.forall(i["semantic_digests"], lambda d: _sure(is_digest(d)))))
    return [("RECORD_INPUTS", "inputs", inputs.isNull() | _sure(whole)), ("RECORD_INPUT_PORTS", "inputs", inputs.isNull() | _sure(F.array_sort(F.array_distinct(ports)) == ports))]


def _effective_inputs() -> Column:
    """Digests of the resolved inputs, by port and in order; null if any is missing."""
    entries = F.array_sort(F.transform(F.map_entries("resolved_inputs"), lambda e: F.struct(e["key"].alias("port"), F.transform(e["value"], lambda x: x["effective_digest"]).alias("semantic_digests"))))
    return F.when(~F.exists(entries, lambda e: F.exists(e["semantic_digests"], lambda d: d.isNull())), entries)


def fact_rules(kind: str) -> list[tuple[str, str, Column]]:
    """(code, field, what must hold) of a fact kind, over its columns."""
    c = F.col
    value = lambda **fields: [("RECORD_VALUE", name, rule) for name, rule in fields.items()]
    keys = lambda *names: {n: _is_key(c(n)) for n in names}
    weak = lambda *names: {n: _weak_or(c(n)) for n in names}
    if kind == "run":
        identities = F.array_append(F.map_values("implementations"), c("engine_identity"))
        origin = c("code_provenance")
        revision = origin["source_revision"]
        return value(
            **keys("run_id", "scope_id"), resume_of=c("resume_of").isNull() | _is_key(c("resume_of")), plan_digest=_sure(is_digest(c("plan_digest"))),
            source_kind=_sure(c("source_kind") == "programmatic"), config_refs=c("config_refs").isNotNull(),
        ) + [
            ("RECORD_IDENTITY", "engine_identity", _sure(F.forall(identities, _identity_ok))),
            ("RECORD_CODE_PROVENANCE", "code_provenance", _is_text(origin["package_version"]) & (revision.isNull() | _sure(revision.rlike(r"\A[0-9a-f]{40}\z")))),
        ]
    if kind == "started":
        a = c("allocation")
        placed = F.forall(F.flatten(F.map_values("resolved_inputs")), lambda x: _is_text(x["manifest_location"]) & _weak_or(x["effective_digest"]))
        return value(
            **keys("run_id", "scope_id", "attempt_id"), task_id=_is_text(c("task_id")), sequence=_sure(c("sequence") >= 1), plan_digest=_sure(is_digest(c("plan_digest"))), **weak("fingerprint", "execution"),
            allocation=_sure((a["cpu_cores"] >= 1) & (a["gpu_count"] >= 0) & (a["memory_bytes"].isNull() | (a["memory_bytes"] > 0))), prepared=c("prepared").isNotNull(), started_at=_is_moment(c("started_at")),
        ) + _input_rules() + [
            ("RECORD_RESOLVED_INPUTS", "resolved_inputs", _sure(placed)), ("RECORD_EFFECTIVE_INPUT_BINDING", "resolved_inputs", _effective_inputs().eqNullSafe(c("inputs"))),
        ]
    if kind == "finished":
        done, code = c("outcome") == "succeeded", c("error_code")
        return value(
            attempt_id=_is_key(c("attempt_id")), outcome=_sure(c("outcome").isin("succeeded", "failed", "interrupted")), retryable=_sure(~c("retryable") | (c("outcome") == "failed")),
            error_code=code.isNull() | _sure(code.isin(*ATTEMPT_CODES)), ended_at=_is_moment(c("ended_at")), receipt=c("receipt").isNull() | _is_text(c("receipt")), evidence=c("evidence").isNotNull(),
        ) + [
            ("RECORD_OUTCOME", "receipt", _sure(done == c("receipt").isNotNull())), ("RECORD_OUTCOME", "retryable", _sure(c("retryable") == _sure(code == RETRYABLE))),
            ("RECORD_OUTCOME", "error_code", _sure(~done | code.isNull())),
        ]
    if kind == "receipt":
        made = F.map_entries("outputs")
        whole = (F.size(made) > 0) & F.forall(made, lambda e: _is_text(e["key"]) & _sure(F.size(e["value"]) > 0))
        return value(
            **keys("attempt_id", "scope_id"), task_id=_is_text(c("task_id")), **weak("fingerprint", "execution"), outputs=_sure(whole), cache_policy=_sure(c("cache_policy").isin("auto", "disabled")),
        ) + _input_rules()
    if kind == "resolution":
        return value(
            task_id=_is_text(c("task_id")), state=_sure(c("state").isin(*TERMINAL)), disposition=c("disposition").isNull() | _sure(c("disposition").isin("executed", "cache_reused")),
            receipt=c("receipt").isNull() | _is_text(c("receipt")), blocked_by=_sure(F.forall("blocked_by", _is_text)), error_code=c("error_code").isNull() | _sure(c("error_code").isin(*RESOLUTION_CODES)),
        ) + [("RECORD_RESOLUTION_EVIDENCE", "fingerprint", _weak_or(c("fingerprint")) & _weak_or(c("execution")) & _sure(F.forall("cache_reasons", _is_text)))]
    if kind == "summary":
        states = F.map_entries("states")
        return value(
            run_id=_is_key(c("run_id")), status=_sure(c("status").isin("SUCCEEDED", "FAILED", "INTERRUPTED")),
            states=_sure(F.forall(states, lambda e: _is_text(e["key"]) & _sure(e["value"].isin(*STATES)))), completion_order=_sure(F.forall("completion_order", _is_text)),
        )
    if kind == "recovery":
        sound = lambda a: _is_key(a["attempt_id"]) & _sure(((a["outcome"] == "succeeded") & _is_text(a["receipt"])) | ((a["outcome"] == "interrupted") & a["receipt"].isNull()))
        return value(source_run=_is_key(c("source_run")), status=_sure(c("status") == "INTERRUPTED"), attempts=c("attempts").isNotNull()) + [("RECORD_RECOVERY", "attempts", _sure(F.forall("attempts", sound)))]
    if kind == "index":
        return value(receipt=_is_text(c("receipt")), receipt_digest=_sure(is_digest(c("receipt_digest"))))
    if kind == "transition":
        return value(task_id=_is_text(c("task_id")), state=_sure(c("state").isin(*STATES)))
    raise ValueError(f"no such fact kind: {kind}")


def check_facts(kind: str, facts: DataFrame, subject: Column) -> DataFrame:
    """An issue for every rule of its kind that a fact breaks."""
    return all_issues(facts, subject, *[issue(~rule, code, field) for code, field, rule in fact_rules(kind)])


def pair_attempts(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Started facts with what finished them, if anything did."""
    end = finished.select("attempt_id", "outcome", "error_code", "retryable", "ended_at", "receipt")
    return started.join(end, "attempt_id", "left").withColumn("open", F.col("outcome").isNull())


def check_attempts(paired: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attempts that aren't their run's, their plan's or their path's, and successes without their own receipt.

    ``paired``: rows of :func:`pair_attempts` with ``path``, the folder of the attempt below the root; ``tasks``:
    plan_digest, task_id.
    """
    r = runs.select("run_id", F.col("scope_id").alias("r_scope"), F.col("plan_digest").alias("r_plan"), F.lit(True).alias("r_there"))
    known = tasks.select("plan_digest", "task_id", F.lit(True).alias("t_there")).distinct()
    rows = paired.join(r, "run_id", "left").join(known, ["plan_digest", "task_id"], "left")
    own = F.concat_ws("/", F.lit("runs"), "run_id", F.lit("attempts"), path_key(F.col("task_id").cast("string")), "attempt_id")
    return all_issues(
        rows,
        F.col("attempt_id"),
        issue(F.col("r_there").isNull() | ~F.col("scope_id").eqNullSafe(F.col("r_scope")), "ATTEMPT_HISTORY_BINDING", "scope_id"),
        issue(~F.col("plan_digest").eqNullSafe(F.col("r_plan")), "ATTEMPT_HISTORY_BINDING", "plan_digest"),
        issue(F.col("t_there").isNull(), "ATTEMPT_HISTORY_BINDING", "task_id"),
        issue(~F.col("path").eqNullSafe(own), "ATTEMPT_HISTORY_BINDING", "path"),
        issue((F.col("outcome") == "succeeded") & ~F.col("receipt").eqNullSafe(F.concat("path", F.lit("/result.json"))), "ATTEMPT_HISTORY_INVALID", "receipt"),
    )


def check_sequence(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts whose sequence isn't their place: it must run 1..n over a task's whole scope."""
    w = Window.partitionBy(*by).orderBy("sequence", "attempt_id")
    rows = attempts.withColumn("place", F.row_number().over(w)).where("place <> sequence")
    return rows.select(F.col("attempt_id").cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit("ATTEMPT_SEQUENCE").alias("code"), F.col("place").cast("string").alias("location"))


def missing_attempts(transitions: DataFrame, attempts: DataFrame, by: list[str]) -> DataFrame:
    """Tasks with more moves to running than known attempts: their history is incomplete."""
    moves = transitions.where("state = 'running'").groupBy(*by).agg(F.count("*").alias("n_running"))
    known = attempts.groupBy(*by).agg(F.count("*").alias("n_attempts"))
    n = moves.join(known, by, "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    return n.where("n_running > n_attempts")


def scope_history(runs: DataFrame, attempts: DataFrame, scope: Column, plan: Column) -> DataFrame:
    """Attempts of every run of a scope under one plan, sibling resumes included, in sequence."""
    own = runs.where((F.col("scope_id") == scope) & (F.col("plan_digest") == plan)).select("run_id")
    return attempts.join(own, "run_id", "left_semi")


def last_attempts(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Number of attempts of each task and the last one by sequence."""
    last = F.max_by(F.struct("outcome", "retryable", "ended_at", "error_code"), "sequence")
    return attempts.groupBy(*by).agg(F.count("*").cast("long").alias("n_attempts"), last.alias("last")).select(*by, "n_attempts", "last.*")


def retry_decision(attempts: DataFrame, policies: DataFrame, by: list[str]) -> DataFrame:
    """``retry``: the last attempt failed retryably or was interrupted, the task may be restarted, and
    attempts are left. ``policies``: by, max_attempts, restartable, backoff."""
    rows = last_attempts(attempts, by).join(policies, [c for c in by if c in policies.columns])
    again = (F.coalesce(F.col("outcome"), F.lit("interrupted")) == "interrupted") | ((F.col("outcome") == "failed") & F.coalesce("retryable", F.lit(False)))
    return rows.withColumn("retry", again & F.col("restartable") & (F.col("n_attempts") < F.col("max_attempts")))


def next_ready(decisions: DataFrame) -> DataFrame:
    """Decisions with the time from which a retry may start."""
    return decisions.where("retry").withColumn("ready_at", F.coalesce("ended_at", F.lit(0.0)) + F.coalesce("backoff", F.lit(0.0)))


def recover(runs: DataFrame, started: DataFrame, finished: DataFrame, receipts: DataFrame, closed: DataFrame) -> DataFrame:
    """Outcome of every open attempt of an unclosed run: succeeded if its receipt agrees, else interrupted.

    ``closed``: run_id of runs with a summary or recovery; those are left alone.
    """
    open_runs = runs.select("run_id").join(closed.select("run_id").distinct(), "run_id", "left_anti")
    left = started.join(open_runs, "run_id", "left_semi").join(finished.select("attempt_id"), "attempt_id", "left_anti")
    sealed = receipts.select("attempt_id", F.col("fingerprint").alias("r_fp"), F.col("execution").alias("r_ex"), F.lit(True).alias("sealed"))
    rows = left.join(sealed, "attempt_id", "left")
    good = F.col("sealed").isNotNull() & F.col("r_fp").eqNullSafe(F.col("fingerprint")) & F.col("r_ex").eqNullSafe(F.col("execution"))
    return rows.select("run_id", "task_id", "attempt_id", F.when(good, "succeeded").otherwise("interrupted").alias("outcome"))


def terminal_states(tasks: DataFrame, attempts: DataFrame, resolutions: DataFrame, by: list[str]) -> DataFrame:
    """State of every task: its resolution, else the last attempt's outcome, else failed."""
    last = attempts.groupBy(*by).agg(F.max_by("outcome", "sequence").alias("outcome"))
    final = resolutions.select(*by, F.col("state").alias("resolved"))
    rows = tasks.select(*by).distinct().join(last, by, "left").join(final, by, "left")
    folded = F.when(F.col("outcome") == "succeeded", "succeeded").otherwise("failed")
    return rows.select(*by, F.coalesce("resolved", folded).alias("state"))


def synthesize_resolutions(states: DataFrame, resolutions: DataFrame, run_status: DataFrame, by: list[str]) -> DataFrame:
    """Resolutions for tasks that have none; the error code follows the run's status."""
    rows = states.join(resolutions.select(*by), by, "left_anti").join(run_status, "run_id", "left")
    ok = F.col("state") == "succeeded"
    code = F.when(~ok, F.when(F.lower("status") == "interrupted", "INTERRUPTED").otherwise("PREFLIGHT_FAILED"))
    return rows.select(*by, "state", F.when(ok, "executed").alias("disposition"), code.alias("error_code"))


def run_status(runs: DataFrame, summaries: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Summary's status, else the recovery's, else running."""
    s = summaries.select("run_id", F.col("status").alias("s"))
    r = recoveries.select("run_id", F.col("status").alias("r"))
    return runs.select("run_id").join(s, "run_id", "left").join(r, "run_id", "left").select("run_id", F.coalesce("s", "r", F.lit("running")).alias("status"))


def summarize_run(states: DataFrame, run: str = "run_id", task: str = "task_id") -> DataFrame:
    """Status and task states per run; succeeded only if every task did."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(task).alias("task"), F.col("state").alias("state"))))
    return states.groupBy(run).agg(F.when(F.bool_and(F.col("state") == "succeeded"), "succeeded").otherwise("failed").alias("status"), entries.alias("states"))


def current_state(transitions: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Latest state of each task by its event order."""
    return transitions.groupBy(*by).agg(F.max_by("state", order).alias("state"))


def check_transitions(transitions: DataFrame, by: list[str], order: list[str], allowed=TRANSITIONS, first: str | None = "pending") -> DataFrame:
    """Steps that aren't in the table of allowed ones; ``first`` is the state before the first event."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag("state").over(w)
    rows = transitions.select(*by, *order, "state", (F.coalesce(before, F.lit(first)) if first else before).alias("was")).where("was IS NOT NULL AND was <> state")
    table = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    return rows.where(~F.array_contains(table, F.concat_ws(">", "was", "state")))


def completion_order(events: DataFrame, run: str, task: str, order: list[str]) -> DataFrame:
    """Tasks of each run as they completed, repeats kept."""
    row = F.struct(*order, F.col(task).alias("completed_task"))
    return events.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["completed_task"]).alias("completion_order"))


def check_receipts(receipts: DataFrame, started: DataFrame, runs: DataFrame) -> DataFrame:
    """Receipts that disagree with their started fact, and started facts that disagree with their run.

    Where both have ``inputs`` those must agree too; where ``started`` has ``path`` its run and attempt must be
    those of the path, and where it has ``recomputed_execution`` (:func:`execution_identity` over what was
    prepared) that must be what it recorded.
    """
    columns = ["scope_id", "task_id", "fingerprint", "execution", *(["inputs"] if "inputs" in started.columns and "inputs" in receipts.columns else [])]
    extra = [c for c in ("path", "recomputed_execution") if c in started.columns]
    s = started.select("attempt_id", "run_id", "plan_digest", *extra, *[F.col(c).alias(f"s_{c}") for c in columns])
    r = runs.select("run_id", F.col("scope_id").alias("r_scope"), F.col("plan_digest").alias("r_plan"))
    rows = receipts.select("attempt_id", *columns).join(s, "attempt_id", "left").join(r, "run_id", "left")
    there = F.col("run_id").isNotNull()
    return all_issues(
        rows,
        F.col("attempt_id"),
        issue(~there, "RECEIPT_WITHOUT_START", "attempt_id"),
        *[issue(there & ~F.col(c).eqNullSafe(F.col(f"s_{c}")), "RECEIPT_BINDING", c) for c in columns],
        issue(there & ~F.col("s_scope_id").eqNullSafe(F.col("r_scope")), "START_BINDING", "scope_id"),
        issue(there & ~F.col("plan_digest").eqNullSafe(F.col("r_plan")), "START_BINDING", "plan_digest"),
        *([issue(there & ~(F.regexp_extract("path", r"runs/([^/]+)/", 1).eqNullSafe(F.col("run_id").cast("string")) & F.regexp_extract("path", r"/([^/]+)$", 1).eqNullSafe(F.col("attempt_id").cast("string"))), "RECEIPT_ATTEMPT", "path")] if "path" in extra else []),
        *([issue(there & ~F.col("recomputed_execution").eqNullSafe(F.col("s_execution")), "RECEIPT_EXECUTION_EVIDENCE", "execution")] if "recomputed_execution" in extra else []),
    )


def resume_steps(runs: DataFrame) -> DataFrame:
    """``(run_id, parent, bad)`` of runs that resume a known run; ``bad`` if that is of another scope or plan."""
    own = runs.where("resume_of IS NOT NULL").select("run_id", F.col("resume_of").alias("parent"), "scope_id", "plan_digest")
    parent = runs.select(F.col("run_id").alias("parent"), F.col("scope_id").alias("p_scope"), F.col("plan_digest").alias("p_plan"))
    same = F.col("scope_id").eqNullSafe(F.col("p_scope")) & F.col("plan_digest").eqNullSafe(F.col("p_plan"))
    return own.join(parent, "parent").select("run_id", "parent", (~same).alias("bad"))


def adopted_identity(runs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``(run_id, task_id, fingerprint, execution, depth)`` of the nearest succeeded resolution along the
    resume chain, the run itself being at depth 0. Runs whose chain is broken (it comes back to a run, or a step goes to
    another scope or plan) have none.

    Path doubling: a run's row points to an ancestor, at first the run that it resumes, and its rows per task hold the
    nearest success before that one. A round takes over the ancestor's pointer and what it knows further up, which doubles
    the distance, in one join and one partially aggregated minimum. A chain of n runs takes log2(n) + 1 rounds; a
    pointer that is still there when the distance exceeds the number of runs goes round in a loop. Nothing grows with
    depth but what is returned: a row per run and task.
    """
    step = checkpointed(resume_steps(runs))
    n = step.count()
    good = resolutions.where("state = 'succeeded'").select("run_id", "task_id", "fingerprint", "execution")
    own = runs.select("run_id").distinct().join(good, "run_id").groupBy("run_id", "task_id").agg(F.min(F.struct(F.lit(0).cast("long").alias("depth"), "fingerprint", "execution")).alias("best"))
    # a row per run that still points somewhere (link), and rows per run and task
    pointers = step.select("run_id", F.struct("parent", "bad").alias("link"))
    no_link, no_task = F.lit(None).cast(pointers.schema["link"].dataType), F.lit(None).cast(own.schema["task_id"].dataType)
    rows = checkpointed(own.select("run_id", "task_id", "best", no_link.alias("link")).unionByName(pointers.select("run_id", no_task.alias("task_id"), F.lit(None).cast(own.schema["best"].dataType).alias("best"), "link")))
    distance, broken = 1, None
    while True:
        ahead = rows.where("link IS NOT NULL AND link.parent IS NOT NULL").select(F.col("run_id").alias("behind"), F.col("link.parent").alias("run_id"), F.col("link.bad").alias("was_bad"))
        if distance > n or ahead.isEmpty():
            break
        met = ahead.join(rows, "run_id")
        deeper = F.when(F.col("best").isNotNull(), F.struct((F.col("best.depth") + distance).alias("depth"), F.col("best.fingerprint").alias("fingerprint"), F.col("best.execution").alias("execution")))
        onward = F.when(F.col("link").isNotNull(), F.struct(F.col("link.parent").alias("parent"), (F.col("link.bad") | F.col("was_bad")).alias("bad")))
        taken = met.select(F.col("behind").alias("run_id"), "task_id", deeper.alias("best"), onward.alias("link"), F.lit(True).alias("taken"))
        kept = rows.select("run_id", "task_id", "best", F.when(F.col("link").isNotNull(), F.struct(F.lit(None).cast(step.schema["parent"].dataType).alias("parent"), F.col("link.bad").alias("bad"))).alias("link"), F.lit(False).alias("taken"))
        # of a run's own link row and the one taken over from its ancestor the pointer is the latter's
        merged = kept.unionByName(taken).groupBy("run_id", "task_id").agg(F.min("best").alias("best"), F.max("link.parent").alias("parent"), F.bool_or("link.bad").alias("bad"))
        rows = checkpointed(merged.select("run_id", "task_id", "best", F.when(F.col("bad").isNotNull(), F.struct("parent", "bad")).alias("link")))
        distance *= 2
    broken = rows.where("link IS NOT NULL AND (link.bad OR link.parent IS NOT NULL)").select("run_id").distinct()
    found = rows.where("best IS NOT NULL").join(broken, "run_id", "left_anti")
    return found.select("run_id", "task_id", "best.fingerprint", "best.execution", "best.depth")


def replan_required(current: DataFrame, adopted: DataFrame, by: list[str], history: DataFrame | None = None) -> DataFrame:
    """Per run whether any identity is weak or differs from the adopted one, or from that of any attempt in
    ``history`` (by, fingerprint, execution)."""
    rows = current.join(adopted.select(*by, F.col("fingerprint").alias("was_fp"), F.col("execution").alias("was_ex")), by, "left")
    weak = ~F.coalesce(is_digest(F.col("fingerprint")) & is_digest(F.col("execution")), F.lit(False))
    other = F.col("was_fp").isNotNull() & ~(F.col("fingerprint").eqNullSafe(F.col("was_fp")) & F.col("execution").eqNullSafe(F.col("was_ex")))
    if history is not None:
        tried = history.select(*by, F.struct(F.col("fingerprint").alias("f"), F.col("execution").alias("e")).alias("t")).groupBy(*by).agg(F.collect_set("t").alias("tried"))
        rows = rows.join(tried, by, "left")
        other = other | F.coalesce(F.exists("tried", lambda t: ~(t["f"].eqNullSafe(F.col("fingerprint")) & t["e"].eqNullSafe(F.col("execution")))), F.lit(False))
    return rows.groupBy(by[0]).agg(F.bool_or(weak | other).alias("replan_required"))


def effective_inputs(refs: DataFrame, evidence: DataFrame, key: str = "record_id") -> DataFrame:
    """``refs`` with ``effective_digest``: null without proof, else the recomputed digest; and ``conflict``
    where the proof contradicts the reference. ``evidence``: key, recomputed."""
    rows = refs.join(evidence.select(key, "recomputed"), key, "left")
    conflict = F.col("recomputed").isNotNull() & F.col("semantic_digest").isNotNull() & (F.col("recomputed") != F.col("semantic_digest"))
    return rows.withColumn("effective_digest", F.when(~conflict, F.col("recomputed"))).withColumn("conflict", conflict)


def local_evidence(refs: DataFrame, receipts: DataFrame, started: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, issues) for references whose locator is that of a manifest of a committed attempt.

    ``refs``: record_id, locator, reference (the whole reference as a text). A locator counts if it reads
    runs/RUN/attempts/TASK/ATTEMPT/manifests/NAME. ``receipts``: attempt_id, task_id, scope_id, fingerprint,
    execution, and outputs (array of port, record_id, reference); ``started``: the same first five and run_id.
    Evidence is record_id, fingerprint, port and attempt_id; a receipt without a fingerprint gives none.
    """
    parts = F.split("locator", "/")
    at = lambda n: F.try_element_at(parts, F.lit(n + 1))
    shaped = (F.size(parts) == 7) & (at(0) == "runs") & (at(2) == "attempts") & (at(5) == "manifests")
    mine = refs.where(shaped).select("record_id", "reference", at(1).alias("l_run"), at(4).alias("l_attempt"))
    bound = ["task_id", "scope_id", "fingerprint", "execution"]
    r = receipts.select(F.col("attempt_id").cast("string").alias("l_attempt"), "outputs", *[F.col(c).alias(f"r_{c}") for c in bound])
    s = started.select(F.col("attempt_id").cast("string").alias("l_attempt"), F.col("run_id").cast("string").alias("s_run"), *[F.col(c).alias(f"s_{c}") for c in bound])
    rows = mine.join(r, "l_attempt").join(s, "l_attempt", "left")
    same = F.lit(True)
    for c in bound:
        same = same & F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}"))
    own = F.element_at(F.filter("outputs", lambda o: o["record_id"].eqNullSafe(F.col("record_id"))), 1)
    rows = rows.withColumn("own", F.when(F.exists("outputs", lambda o: o["record_id"].eqNullSafe(F.col("record_id"))), own)).withColumn("placed", F.col("l_run").eqNullSafe(F.col("s_run"))).withColumn("same", same)
    conflict = F.col("same") & F.col("placed") & F.col("own").isNotNull() & ~F.col("own.reference").eqNullSafe(F.col("reference"))
    issues = all_issues(
        rows,
        F.col("record_id"),
        issue(~F.col("same"), "INPUT_RECEIPT_BINDING", "receipt"),
        issue(F.col("same") & ~F.col("placed"), "INPUT_RECEIPT_LOCATION", "locator"),
        issue(conflict, "INPUT_COMMITTED_REF_CONFLICT", "reference"),
    )
    good = rows.where(F.col("same") & F.col("placed") & F.col("own").isNotNull() & F.col("own.reference").eqNullSafe(F.col("reference")) & F.col("r_fingerprint").isNotNull())
    return good.select("record_id", F.col("r_fingerprint").alias("fingerprint"), "own.port", F.col("l_attempt").alias("attempt_id")), issues


def classify_errors(df: DataFrame, cause: str = "cause") -> DataFrame:
    """Error code and whether it may be retried, from a cause."""
    c = F.col(cause)
    code = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, value in ERROR_CODES.items():
        code = code.when(c == name, value)
    code = code.otherwise(OTHER_ERROR)
    return df.withColumn("error_code", code).withColumn("retryable", F.coalesce(code == "EXECUTION_RETRYABLE", F.lit(False)))


def check_evidence_inputs(started: DataFrame, key: str = "attempt_id") -> DataFrame:
    """Started facts whose recorded inputs aren't their effective digests regrouped by port.

    ``resolved``: array of (port, ord, effective_digest); ``inputs``: array of (port, semantic_digests) or
    null if any digest is missing. All in one row, so nothing is shuffled.
    """
    ports = F.array_sort(F.array_distinct(F.transform("resolved", lambda r: r["port"])))
    digests = lambda p: F.transform(F.array_sort(F.transform(F.filter("resolved", lambda r: r["port"] == p), lambda r: F.struct(r["ord"], r["effective_digest"].alias("d")))), lambda r: r["d"])
    regrouped = F.transform(ports, lambda p: F.struct(p.alias("port"), digests(p).alias("semantic_digests")))
    whole = F.when(F.exists("resolved", lambda r: r["effective_digest"].isNull()), F.lit(None)).otherwise(regrouped)
    return all_issues(started, F.col(key), issue(~whole.eqNullSafe(F.col("inputs")), "RECORD_EFFECTIVE_INPUT_BINDING", "inputs"))
