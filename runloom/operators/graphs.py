"""Task graphs, many plans at once: edges, structure, order, port contracts, blocking, resources."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.issues import ERROR, UNVERIFIED, all_issues, issue
from runloom.operators.walks import LIMIT, walk, walked
from runloom.sources.shared import checkpointed, dealt, shared_folder, small


def edges(inputs: DataFrame, plan: str = "plan_id", task: str = "task_id", source: str = "src_task") -> DataFrame:
    """Distinct ``(plan, parent, child)`` of inputs that other tasks feed."""
    return inputs.where(F.col(source).isNotNull()).select(F.col(plan).alias("plan"), F.col(source).alias("parent"), F.col(task).alias("child")).distinct()


def dependents(e: DataFrame) -> DataFrame:
    """Sorted children of each task that has any."""
    return e.groupBy("plan", "parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def check_structure(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """Duplicate tasks and ports, self references, unknown tasks and ports, and externals that are
    duplicate, conflicting, or not the ones consumed.

    ``tasks``: plan_id, task_id. ``inputs``: plan_id, task_id, port, ord, src_task, src_port, artifact.
    ``outputs``: plan_id, task_id, port. ``externals``: plan_id, record_id, reference.
    """
    subject, key, source = F.col("plan_id"), ["plan_id", "task_id"], ["plan_id", "src_task"]

    def found(df: DataFrame, code: str, location: str) -> DataFrame:
        return df.select(subject.cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit(code).alias("code"), F.col(location).cast("string").alias("location"))

    fed = inputs.where("src_task <> task_id").select(*key, "src_task", "src_port")
    there = dealt(tasks.select("plan_id", F.col("task_id").alias("src_task")), *source).distinct().withColumn("there", F.lit(True))
    made = dealt(outputs.select("plan_id", F.col("task_id").alias("src_task"), F.col("port").alias("src_port")), *source).distinct().withColumn("made", F.lit(True))
    lost = dealt(fed, *source).join(made, [*source, "src_port"], "left").join(there, source, "left").where("there IS NULL OR made IS NULL")
    # what is said of a task, and what its inputs ask for in vain, are rows of one table, and meet in one aggregate
    own = F.coalesce(F.col("src_task") == F.col("task_id"), F.lit(False))
    none = F.lit(None).cast(inputs.schema["port"].dataType).alias("port")
    rows = tasks.select(*key, none, F.lit("task").alias("what")).unionByName(outputs.select(*key, "port", F.lit("output").alias("what")))
    rows = rows.unionByName(inputs.select(*key, "port", F.when(own, "self").otherwise("input").alias("what")))
    rows = rows.unionByName(lost.select(*key, none, F.when(F.col("there").isNull(), "no task").otherwise("no port").alias("what")))
    is_ = lambda *what: F.col("what").isin(*what)
    met = dealt(rows, *key).groupBy(*key, "port").agg(
        F.count_if(is_("task")).alias("n_tasks"), F.count_if(is_("output")).alias("n_out"), F.max(is_("input", "self")).alias("into"), *[F.max(is_(w)).alias(w) for w in ("self", "no task", "no port")],
    )
    both = F.col("into") & (F.col("n_out") > 0) & F.col("plan_id").isNotNull() & F.col("task_id").isNotNull() & F.col("port").isNotNull()
    met = met.groupBy(*key).agg(F.sum("n_tasks").alias("n_tasks"), F.max((F.col("n_out") > 1) | both).alias("twice"), *[F.max(w).alias(w) for w in ("self", "no task", "no port")])
    out = all_issues(
        met,
        subject,
        issue(F.col("n_tasks") > 1, "PLAN_DUPLICATE_TASK", F.col("task_id")),
        issue(F.col("twice"), "PLAN_DUPLICATE_PORT", F.col("task_id")),
        issue(F.col("self"), "PLAN_SELF_REFERENCE", F.col("task_id")),
        issue(F.col("no task"), "PLAN_UNKNOWN_TASK", F.col("task_id")),
        issue(F.col("no port"), "PLAN_UNKNOWN_PORT", F.col("task_id")),
    )
    if externals is not None:
        per = externals.groupBy("plan_id", "record_id").agg(F.count("*").alias("n"), F.count_distinct("reference").alias("refs"))
        out = out.unionByName(found(per.where("n > 1 AND refs = 1"), "PLAN_DUPLICATE_EXTERNAL", "record_id"))
        out = out.unionByName(found(per.where("refs > 1"), "PLAN_CONFLICTING_EXTERNAL", "record_id"))
        used = inputs.where("artifact IS NOT NULL").select("plan_id", F.col("artifact").alias("reference"), F.lit(True).alias("used")).distinct()
        said = externals.select("plan_id", "reference", F.lit(True).alias("said")).distinct()
        odd = used.join(said, ["plan_id", "reference"], "full_outer").where("used IS NULL OR said IS NULL").select("plan_id").distinct()
        out = out.unionByName(found(odd, "PLAN_EXTERNAL_SET", "plan_id"))
    return out


def _longest(rows: list[tuple]) -> Iterator[tuple]:
    """(task, level) of one plan from (task, parent) rows; None for tasks on or behind a cycle."""
    children: dict = {}
    waits: dict = {}
    own = []
    for task, parent in set(rows):
        if parent is None:
            own.append(task)
        else:
            children.setdefault(parent, []).append(task)
            waits[task] = waits.get(task, 0) + 1
    placed: dict = {}
    front, at = [t for t in own if t not in waits], 0  # a parent that is no task is never placed
    while front:
        following = []
        for t in front:
            placed[t] = at
            for c in children.get(t, ()):
                waits[c] -= 1
                if waits[c] == 0:
                    following.append(c)
        front, at = following, at + 1
    return ((t, placed.get(t)) for t in own)


def levels(nodes: DataFrame, e: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(plan, task, level)``: longest path from a root; null for tasks on or behind a cycle.

    Plans of up to ``limit`` tasks and edges, repeats included, are walked, each in one task, in time linear in their size. Larger
    ones are peeled together: a round takes the edges out of the tasks placed last, and the children that no other edge
    holds are placed next, so there are as many rounds as the deepest of them has levels. Each round appends what it
    placed to a table in the shared folder, and reads only the edges that are left.
    """
    kind = dict(nodes.dtypes)["task"]
    tasks = nodes.select("plan", "task")
    links = e.where("parent IS NOT NULL").select("plan", "parent", "child")
    rows = tasks.withColumn("parent", F.lit(None).cast(kind)).unionByName(links.select("plan", F.col("child").cast(kind).alias("task"), F.col("parent").cast(kind).alias("parent")))
    out, large = walked(rows, "plan", _longest, f"task {kind}, level long", limit)
    if large is None:
        return out
    return out.unionByName(_peeled(tasks.join(large, "plan", "left_semi").distinct(), links.join(large, "plan", "left_semi").distinct()))


def _peeled(tasks: DataFrame, links: DataFrame) -> DataFrame:
    spark = tasks.sparkSession
    to = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    tasks = checkpointed(tasks)
    open_ = checkpointed(links)
    ready = checkpointed(tasks.join(open_.select("plan", F.col("child").alias("task")), ["plan", "task"], "left_anti"))
    for level in itertools.count():
        ready.withColumn("level", F.lit(level).cast("long")).write.mode("append").parquet(to)
        placed = ready.select("plan", F.col("task").alias("parent"), F.lit(True).alias("gone"))
        marked = checkpointed(open_.join(placed, ["plan", "parent"], "left"))
        open_ = marked.where("gone IS NULL").select("plan", "parent", "child")
        freed = marked.where("gone").select("plan", F.col("child").alias("task")).distinct()
        ready = checkpointed(freed.join(open_.select("plan", F.col("child").alias("task")), ["plan", "task"], "left_anti"))
        if ready.isEmpty():
            break
    return tasks.join(spark.read.parquet(to), ["plan", "task"], "left")


def cycles(leveled: DataFrame) -> DataFrame:
    """Tasks that :func:`levels` couldn't place."""
    return leveled.where("level IS NULL").select("plan", "task")


def _smallest_first(links: list[tuple[str, str | None]]) -> list[str]:
    """Tasks of one plan from (task, parent) rows, the smallest ready one first."""
    children: dict[str, list[str]] = {}
    waits = {task: 0 for task, _ in links}
    for task, parent in dict.fromkeys(links):
        if parent is not None:
            children.setdefault(parent, []).append(task)
            waits[task] += 1
    ready = [t for t, n in waits.items() if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        t = heapq.heappop(ready)
        out.append(t)
        for c in children.get(t, ()):
            waits[c] -= 1
            if waits[c] == 0:
                heapq.heappush(ready, c)
    return out


def topological_order(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """``(plan, task, place)``: at each step the smallest ready task; tasks in cycles have no place.

    The order inside one plan is sequential; plans are independent. Rows are dealt and sorted by plan, and
    a task walks through its plans holding one at a time: a plan is a hand-written graph of bounded size.
    """
    own = nodes.select("plan", F.col("task").cast("string").alias("task"), F.lit(None).cast("string").alias("parent"))
    links = e.select("plan", F.col("child").cast("string").alias("task"), F.col("parent").cast("string").alias("parent"))
    return walk(own.unionByName(links), "plan", lambda rows: ((t, i) for i, t in enumerate(_smallest_first(rows))), "task string, place long")


def check_ports(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, ports: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """Tasks against the port contracts of their operations.

    ``tasks``: plan_id, task_id, operation_id, and with ``operations`` the array capabilities of what runs
    them. ``inputs``: plan_id, task_id, port, src_task, src_port, and for sources outside the plan schema_id.
    ``outputs``: plan_id, task_id, port, schema_id, profile_id, count. ``ports``: operation_id, direction, port,
    schema_id, profile_id, min_count, max_count. ``operations``: operation_id, required_capabilities. An
    output of count n feeds n inputs; sources outside the plan are unverified, and so is their profile where
    one is asked for.
    """
    subject = F.concat_ws("/", "plan_id", "task_id")
    key, source = ["plan_id", "task_id", "port"], ["plan_id", "src_task", "src_port"]
    src = outputs.select("plan_id", F.col("task_id").alias("src_task"), F.col("port").alias("src_port"), F.col("schema_id").alias("made_schema"), F.col("profile_id").alias("made_profile"), F.col("count").alias("n"))
    own = F.col("schema_id") if "schema_id" in inputs.columns else F.lit(None).cast("string")
    flow = dealt(inputs.select(*key, "src_task", "src_port", own.alias("own_schema")), *source).join(dealt(src, *source), source, "left")
    outside = F.col("src_task").isNull()
    # what is asked of a port, what flows into it and what is declared for it are rows of one table, and meet in one aggregate
    asked = tasks.select("plan_id", "task_id", "operation_id").join(small(ports), "operation_id")
    asked = asked.select(*key, "direction", F.struct("schema_id", "profile_id", "min_count", "max_count").alias("want"))
    got = F.when(outside, F.col("own_schema")).otherwise(F.col("made_schema"))
    flowing = flow.select(*key, F.lit("input").alias("direction"), F.struct(got.alias("schema"), F.col("made_profile").alias("profile"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), outside.alias("outside")).alias("one"))
    declared = outputs.select(*key, F.lit("output").alias("direction"), F.struct(F.col("schema_id").alias("schema"), F.col("profile_id").alias("profile"), F.col("count").cast("long").alias("n"), F.lit(False).alias("outside")).alias("one"))
    rows = flowing.unionByName(declared)
    rows = rows.withColumn("want", F.lit(None).cast(asked.schema["want"].dataType)).unionByName(asked.withColumn("one", F.lit(None).cast(rows.schema["one"].dataType)))
    there, one = F.col("one").isNotNull(), lambda name: F.col(f"one.{name}")
    typed = there & ~one("outside") & (one("schema").isNotNull() | (F.col("direction") == "output"))
    met = dealt(rows, *key, "direction").groupBy(*key, "direction").agg(
        F.max("want").alias("want"), F.count_if(there).alias("n_rows"), F.coalesce(F.sum(one("n")), F.lit(0)).alias("total"), F.count_if(one("outside")).alias("n_external"), F.min(one("schema")).alias("low"), F.max(one("schema")).alias("high"),
        F.count_if(typed & one("profile").isNull()).alias("n_bare"), F.min(F.when(typed, one("profile"))).alias("low_profile"), F.max(F.when(typed, one("profile"))).alias("high_profile"), F.min(one("n")).alias("least"), F.max(one("n")).alias("most"),
    )
    want = lambda name: F.col(f"want.{name}")
    given, into = F.col("want").isNotNull(), F.col("direction") == "input"
    yes = lambda c: F.coalesce(c, F.lit(False))
    schema = yes((F.col("low") != want("schema_id")) | (F.col("high") != want("schema_id")))
    profile = (F.col("n_bare") > 0) | yes((F.col("low_profile") != want("profile_id")) | (F.col("high_profile") != want("profile_id")))
    made_profile = F.when(want("profile_id").isNull(), F.col("low_profile").isNotNull()).otherwise(profile)
    number = yes((F.col("least") != want("min_count")) | (F.col("most") != want("min_count")))
    port = F.col("port")
    out = all_issues(
        met,
        subject,
        issue(into & ~given, "PLAN_PORT_SET", port),
        issue(into & given & ((F.col("total") < want("min_count")) | yes(F.col("total") > want("max_count"))), "PLAN_INPUT_COUNT", port),
        issue(into & (F.col("n_external") > 0), "PLAN_EXTERNAL_RECORD_UNVERIFIED", port, UNVERIFIED),
        issue(into & (F.col("n_external") > 0) & want("profile_id").isNotNull(), "PLAN_EXTERNAL_PROFILE_UNVERIFIED", port, UNVERIFIED),
        issue(into & given & schema, "PLAN_INPUT_SCHEMA", port),
        issue(into & given & want("profile_id").isNotNull() & profile, "PLAN_INPUT_PROFILE", port),
        issue(~into & (~given | (F.col("n_rows") == 0)), "PLAN_PORT_SET", port),
        issue(~into & given & (F.col("n_rows") > 0) & (schema | made_profile | number), "PLAN_OUTPUT_CONTRACT", port),
    )
    if operations is None:
        return out
    able = tasks.select("plan_id", "task_id", "operation_id", "capabilities").join(small(operations), "operation_id")
    none = F.array().cast("array<string>")
    lacking = F.array_except("required_capabilities", F.coalesce("capabilities", none))
    return out.unionByName(all_issues(able, subject, issue(F.size(lacking) > 0, "PLAN_CAPABILITY", F.array_join(F.array_sort(lacking), ","))))


def _spread(rows: list[tuple]) -> Iterator[tuple]:
    """(task, blocked_by) of one plan from (task, parent, state) rows, which are edges or states."""
    children: dict = {}
    bad, open_ = set(), set()
    for task, parent, state in rows:
        if parent is not None:
            children.setdefault(parent, set()).add(task)
        elif state in ("failed", "blocked"):
            bad.add(task)
        if parent is None and state is not None and state not in ("succeeded", "failed"):
            open_.add(task)
    front, by = list(bad), {}
    while front:
        parent = front.pop()
        for c in children.get(parent, ()):
            if c in open_:
                by.setdefault(c, []).append(parent)
                if c not in bad:
                    bad.add(c)
                    front.append(c)
    return ((task, sorted(parents)) for task, parents in by.items())


def blocked(e: DataFrame, states: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(plan, task, blocked_by)``: transitive descendants of failed or blocked tasks that have not ended,
    with their direct blockers, sorted.

    ``states``: plan, task, state. Plans of up to ``limit`` edges and states, repeats included, are walked, each in one task. In larger
    ones a round spreads from the tasks found last, so there are as many rounds as the longest path behind a
    failure; each appends what it reached to a table in the shared folder.
    """
    kind = dict(states.dtypes)["task"]
    links = e.where("parent IS NOT NULL").select("plan", F.col("child").cast(kind).alias("task"), F.col("parent").cast(kind).alias("parent"))
    rows = links.withColumn("state", F.lit(None).cast("string")).unionByName(states.select("plan", "task", F.lit(None).cast(kind).alias("parent"), "state").where("state IS NOT NULL"))
    out, large = walked(rows, "plan", _spread, f"task {kind}, blocked_by array<{kind}>", limit)
    if large is None:
        return out
    return out.unionByName(_reached(links.join(large, "plan", "left_semi").distinct(), states.join(large, "plan", "left_semi")))


def _reached(links: DataFrame, states: DataFrame) -> DataFrame:
    spark = links.sparkSession
    to = f"{shared_folder(spark)}/blocked-{uuid.uuid4().hex}"
    links = checkpointed(links)
    waiting = checkpointed(states.where(~F.col("state").isin("succeeded", "failed")).select("plan", "task").distinct())
    front = checkpointed(states.where(F.col("state").isin("failed", "blocked")).select("plan", "task").distinct())
    open_ = waiting.join(front, ["plan", "task"], "left_anti")  # not bad yet
    while True:
        front.write.mode("append").parquet(to)
        reached = links.join(front.select("plan", F.col("task").alias("parent")), ["plan", "parent"], "left_semi").select("plan", "task").distinct()
        front = checkpointed(open_.join(reached, ["plan", "task"], "left_semi"))
        if front.isEmpty():
            break
        open_ = checkpointed(open_.join(front, ["plan", "task"], "left_anti"))
    bad = spark.read.parquet(to).select("plan", F.col("task").alias("parent"))
    by = links.join(waiting, ["plan", "task"], "left_semi").join(bad, ["plan", "parent"], "left_semi")
    return by.groupBy("plan", "task").agg(F.array_sort(F.collect_list("parent")).alias("blocked_by"))


def ready(e: DataFrame, states: DataFrame, now: float, next_ready: str | None = None) -> DataFrame:
    """Pending tasks all of whose parents succeeded and whose backoff is over."""
    waiting = states.where("state = 'pending'")
    if next_ready:
        waiting = waiting.where(F.coalesce(F.col(next_ready), F.lit(0.0)) <= now)
    unfinished = states.where("state <> 'succeeded'").select("plan", F.col("task").alias("parent"))
    held = e.join(unfinished, ["plan", "parent"], "left_semi").select("plan", F.col("child").alias("task"))
    return waiting.select("plan", "task").join(held, ["plan", "task"], "left_anti")


def plan_report(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Per task the reasons why its recipe is unresolved before a run."""
    fed = e.select("plan", F.col("child").alias("task"), F.lit(True).alias("fed")).distinct()
    reasons = F.when(F.col("fed"), F.array(F.lit("EXECUTION_IDENTITY_UNPROBED"), F.lit("UPSTREAM_OUTPUT_PENDING"))).otherwise(F.array(F.lit("EXECUTION_IDENTITY_UNPROBED")))
    return nodes.select("plan", "task").distinct().join(fed, ["plan", "task"], "left").select("plan", "task", F.lit("unresolved").alias("status"), reasons.alias("reasons"))


def resource_feasible(tasks: DataFrame, cpu: int, gpu: int, memory: int | None) -> DataFrame:
    """``tasks`` with ``feasible``: within the budget; asked memory needs a known, sufficient one."""
    asks = F.col("memory").isNull() | (F.lit(memory).isNotNull() & F.coalesce(F.col("memory") <= F.lit(memory), F.lit(False)))
    return tasks.withColumn("feasible", (F.col("cpu") <= cpu) & (F.col("gpu") <= gpu) & asks)


def resource_timeline(attempts: DataFrame, by: list[str], start: str, end: str, amounts: list[str]) -> DataFrame:
    """Running sums of ``amounts`` at every start and end; ends come before starts at the same time.

    ``by`` splits the timeline (one per run or host). Sums have two levels, so that one run or host with most of the
    attempts is spread over tasks: rows are range-partitioned by group and time, each partition sums up its own, and
    the totals of the partitions before it in the same group, a row per partition, are added.
    """
    up = attempts.select(*by, F.col(start).alias("at"), F.lit(1).alias("step"), *[F.col(a) for a in amounts])
    down = attempts.where(F.col(end).isNotNull()).select(*by, F.col(end).alias("at"), F.lit(0).alias("step"), *[(-F.col(a)).alias(a) for a in amounts])
    per = up.unionByName(down).groupBy(*by, "at", "step").agg(*[F.sum(a).alias(a) for a in amounts])
    placed = checkpointed(per.repartitionByRange(*by, "at", "step").withColumn("timeline_part", F.spark_partition_id()))
    so_far = Window.partitionBy(*by, "timeline_part").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("timeline_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "timeline_part").agg(*[F.sum(a).alias(a) for a in amounts])
    offsets = totals.select(*[F.col(b).alias(f"of_{b}") for b in by], F.col("timeline_part").alias("of_part"), *[F.sum(a).over(before).alias(f"{a}_before") for a in amounts])
    same = F.col("timeline_part") == F.col("of_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"of_{b}"))
    running = placed.select(*by, "at", "step", "timeline_part", *[F.sum(a).over(so_far).alias(a) for a in amounts]).join(offsets, same, "left")
    return running.select(*by, "at", "step", *[(F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(f"{a}_before"), F.lit(0))).alias(f"{a}_running") for a in amounts])
