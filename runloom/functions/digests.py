"""Identity digests: canonical JSON, domain separation, ordered aggregation, SHA-256."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.exprs import fingerprint_struct, is_digest, with_fingerprint

#: Default prefix of the digest domains; callers pass their own to match other records.
PREFIX = "runloom"


def domain_digest(domain: str | Column, text: Column) -> Column:
    """SHA-256 of the domain, a zero byte and the canonical text."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return F.sha2(F.concat(domain.cast("binary"), F.unhex(F.lit("00")), text.cast("binary")), 256)


def canonical(**fields: Column) -> Column:
    """Compact JSON of an object with its keys sorted; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def _plain(t: T.DataType) -> bool:
    """Whether ``to_json`` writes values of a type as it writes a VARIANT of them, but for the order of keys."""
    if isinstance(t, T.StructType):
        return len(t) > 0 and all(_plain(f.dataType) for f in t)
    return _plain(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _by_name(c: Column, t: T.DataType) -> Column:
    """``c`` with the fields of its structs in the order of a VARIANT's keys, that of UTF-16."""
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _by_name(x, t.elementType)) if isinstance(t.elementType, (T.ArrayType, T.StructType)) else c
    if not isinstance(t, T.StructType):
        return c
    return F.when(c.isNotNull(), F.struct(*[_by_name(c[f.name], f.dataType).alias(f.name) for f in sorted(t, key=lambda f: f.name.encode("utf-16-be"))]))


def canonical_text(df: DataFrame, c: Column) -> Column:
    """JSON of a struct column of ``df`` with the keys of every object in order and nulls written; a VARIANT is made only of types whose text needs it."""
    t = df.select(c.alias("c")).schema["c"].dataType
    return F.to_json(_by_name(c, t), {"ignoreNullFields": "false"}) if _plain(t) else F.to_json(F.to_variant_object(c))


def _value(df: DataFrame, c: Column) -> Column:
    """JSON of a column of any type as it stands in an object, ``null`` where it is null."""
    whole = canonical_text(df, F.struct(c.alias("v")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def ordered(group: DataFrame, by: list[str], order: list[str], value: Column, separator: str = ",") -> DataFrame:
    """One text per group: ``value`` of its rows, in order, repeats kept. Ties of the order are broken by the value."""
    row = F.struct(*[F.col(o) for o in order], value.alias("digest_value"))
    return group.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["digest_value"]), separator).alias("text"))


def manifest_digest(df: DataFrame, content: str, declared: str) -> DataFrame:
    """``df`` with the digest of its stored bytes and whether it is the declared one."""
    got = F.sha2(F.col(content).cast("binary"), 256)
    return df.withColumn("manifest_digest", got).withColumn("verified", F.coalesce(got == F.col(declared), F.lit(False)))


def streamed_digest(rows: DataFrame, by: list[str], order: list[str], text: Column, domain: str, openings: list[str], section: Column | None = None, also: list[Column] | None = None, decided: bool = False, distinct: bool = False) -> DataFrame:
    """``(by, digest, n, also)``: the domain digest of a text per group that is put together row by row, ``text`` after text.

    ``openings`` stand before, between and behind the sections of the text; ``section`` (0, 1, ...) tells to which a row
    belongs, and inside of it rows are joined by commas in ``order`` (nulls first), then by their text, repeats kept unless
    ``distinct``. A group of only null texts has empty sections. ``also`` are booleans that must hold for every row (their
    conjunction). Rows are dealt by group and sorted; a task hashes them as they come and holds a batch of them, however many a
    group has. If rows of equal places have equal texts (``decided``), these are made after sorting and not shuffled; ``rows``
    should then have no other columns.
    """
    also = also or []
    keys = [f"k{i}" for i in range(len(by))]
    places = [f"o{i}" for i in range(len(order))]
    flags = [f"f{i}" for i in range(len(also))]
    part = (F.lit(0) if section is None else section).cast("int").alias("section")
    own = [*[F.col(b).alias(k) for b, k in zip(by, keys)], part, text.alias("text"), *[F.coalesce(a, F.lit(False)).alias(f) for a, f in zip(also, flags)]]
    if decided:
        named = rows.repartition(*by).sortWithinPartitions(*by, *([] if section is None else [section.cast("int")]), *order).select(*own)
    else:
        named = rows.select(*own, *[F.col(o).alias(p) for o, p in zip(order, places)]).repartition(*keys).sortWithinPartitions(*keys, "section", *places, "text").select(*keys, "section", "text", *flags)
    kinds = [f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "digest string", "n long", *[f"{f} boolean" for f in flags]])
    head = domain.encode() + b"\0"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        types, current, h, at, n, first, held, last = None, None, None, 0, 0, True, [], None

        def close() -> None:
            for x in openings[at:]:
                h.update(x.encode())
            done.append((*current, h.hexdigest(), n, *held))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            own = [*types, pa.string(), pa.int64(), *[pa.bool_()] * len(flags)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, own)], names=[*keys, "digest", "n", *flags])

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            columns = [c.to_pylist() for c in b.columns]
            texts, good, begin = columns[len(keys) + 1], columns[len(keys) + 2 :], 0
            # rows of one group and section are hashed together, as far as the batch goes
            for (*group, part), same in itertools.groupby(zip(*columns[: len(keys) + 1])):
                end = begin + sum(1 for _ in same)
                pieces, oks, begin = texts[begin:end], [g[begin:end] for g in good], end
                if group != current:
                    if h is not None:
                        close()
                        if len(done) >= 10_000:
                            yield flush()
                    current, h, at, n, first, held, last = group, hashlib.sha256(head), 0, 0, True, [True] * len(flags), None
                while at <= part:
                    h.update(openings[at].encode())
                    at, first, last = at + 1, True, None
                if None in pieces:
                    pieces = [p for p in pieces if p is not None]
                if distinct:
                    pieces = [p for p, q in zip(pieces, [last, *pieces]) if p != q]
                if pieces:
                    h.update(("" if first else ",").encode() + ",".join(pieces).encode())
                    n, first, last = n + len(pieces), False, pieces[-1]
                held = [x and all(y) for x, y in zip(held, oks)]
        if h is not None:
            close()
        if done:
            yield flush()

    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "digest", "n", *flags)


def directory_digest(members: DataFrame, key: str = "dir_id", path: str = "path", kind: str = "kind", digest: str = "digest", domain: str = f"{PREFIX}.directory.v1", distinct: bool = False) -> DataFrame:
    """``(key, identity)``: digest over members in order of path; weak if any file's digest is. A directory may have any number of
    members; with ``distinct`` those that are the same in all three count once."""
    strong = (F.col(kind) != "file") | F.coalesce(is_digest(F.col(digest)), F.lit(False))
    text = F.to_json(F.struct(F.col(path).alias("path"), F.col(kind).alias("kind"), F.col(digest).alias("digest")), {"ignoreNullFields": "false"})
    out = streamed_digest(members.select(key, path, kind, digest), [key], [path, kind, digest], text, domain, ["[", "]"], also=[strong], decided=True, distinct=distinct)
    reasons = F.when(F.col("f0"), F.array().cast("array<string>")).otherwise(F.array(F.lit("MEMBER_UNVERIFIED")))
    return out.select(key, fingerprint_struct(F.col("digest"), reasons).alias("identity"))


def scope_digest(files: DataFrame, key: str = "scope", name: str = "name", digest: str = "digest", domain: str = f"{PREFIX}.code.v1", distinct: bool = False) -> DataFrame:
    """``(key, identity)`` over logical name to digest, whatever the location; empty or weak scopes have none. With ``distinct``
    repeats are left out, which takes no shuffle of its own."""
    named = files.where(F.col(name).isNotNull())
    kinds = named.withColumnRenamed(digest, "digest").withColumn("kind", F.lit("file"))
    return directory_digest(kinds, key, name, "kind", "digest", domain, distinct)


def input_identities(inputs: DataFrame, by: list[str], port: str = "port", order: str = "ord", digest: str = "semantic_digest", also: Sequence[Column] = ()) -> DataFrame:
    """``(by, inputs array<struct<port, semantic_digests>>, strong, also)``: ports sorted, order and repeats inside
    a port kept; ``inputs`` is null if any digest is weak. ``also`` are further aggregates of the same rows.

    Rows are grouped once. If they are dealt by ``by`` already, before they were widened, they aren't shuffled again.
    """
    ok = F.coalesce(is_digest(F.col(digest)), F.lit(False))
    row = F.struct(F.col(port).alias("p"), F.col(order).alias("o"), F.col(digest).alias("d"))
    out = inputs.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("x"), F.bool_and(ok).alias("strong"), *also)
    port_at = lambda i: F.get("x", i - 1)["p"]
    # where the inputs of a port begin, and where the last ones end
    begins = F.filter(F.sequence(F.lit(1), F.size("x")), lambda i: (i == 1) | ~port_at(i).eqNullSafe(port_at(i - 1)))
    out = out.withColumn("begins", F.when(F.col("strong"), F.concat(begins, F.array(F.size("x") + 1))))
    each = lambda b, i: F.struct(port_at(b).alias("port"), F.slice("x", b, F.get("begins", i + 1) - b)["d"].alias("semantic_digests"))
    found = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), each)
    return out.withColumn("inputs", F.when(F.col("strong"), found)).drop("x", "begins")


def input_lineage_digest(inputs: DataFrame, by: list[str], port: str = "port", order: str = "ord", digest: str = "semantic_digest", domain: str = f"{PREFIX}.lineage.v1") -> DataFrame:
    """``(by, digest, n)`` of what :func:`input_identities` lists, without holding the list: one port may take any number of inputs.

    A text per input, ports in order, the inputs of a port in theirs, repeats kept; null if any digest is weak.
    """
    ok = is_digest(F.col(digest))
    text = F.to_json(F.struct(F.col(port).alias("port"), F.col(digest).alias("semantic_digest")), {"ignoreNullFields": "false"})
    out = streamed_digest(inputs, by, [port, order], text, domain, ["[", "]"], also=[ok])
    return out.select(*by, F.when(F.col("f0"), F.col("digest")).alias("digest"), "n")


def execution_identity(prepared: DataFrame, domain: str = f"{PREFIX}.execution.v1") -> DataFrame:
    """``prepared`` with ``identity``: what was prepared plus the allocation of cores, memory left out.

    Columns: status and ``evidence`` (digests of what proves it, an array) of the prepared identity; its
    schema_version, wrapper_digest, ``native_components`` (map of name to executable_digest and the map
    dependency_digests), ``settings`` (canonical JSON of an object) and ``external_resource_digests`` (map),
    null where absent; cpu_cores and gpu_count. The first rule that fails is the one reason.
    """
    c = F.col
    strong = lambda m: F.coalesce(F.forall(F.map_values(m), lambda d: F.coalesce(is_digest(d), F.lit(False))), F.lit(False))
    native = F.forall(F.map_values("native_components"), lambda n: F.coalesce(is_digest(n["executable_digest"]), F.lit(False)) & strong(n["dependency_digests"]))
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = (
        F.when(c("status") == "unknown", "EXECUTION_IDENTITY_UNKNOWN")
        .when(bad(c("status") == "known"), "EXECUTION_IDENTITY_INCOMPLETE")
        .when(c("schema_version").isNull() | c("native_components").isNull() | c("settings").isNull() | c("external_resource_digests").isNull(), "EXECUTION_IDENTITY_INCOMPLETE")
        .when(c("schema_version") != 1, "EXECUTION_IDENTITY_VERSION")
        .when(bad(is_digest(c("wrapper_digest"))), "WRAPPER_IDENTITY_WEAK")
        .when(bad(native), "NATIVE_IDENTITY_WEAK")
        .when(~strong(c("external_resource_digests")), "RESOURCE_IDENTITY_WEAK")
        .when(bad(F.forall("evidence", lambda d: F.coalesce(is_digest(d), F.lit(False)))), "EXECUTION_EVIDENCE_WEAK")
        .when(bad((c("cpu_cores") >= 1) & (c("gpu_count") >= 0)), "IDENTITY_ALLOCATION")
    )
    ordered_map = lambda m: F.map_from_entries(F.sort_array(F.map_entries(m)))
    component = lambda e: F.struct(e["key"].alias("key"), F.struct(ordered_map(e["value"]["dependency_digests"]).alias("dependency_digests"), e["value"]["executable_digest"].alias("executable_digest")).alias("value"))
    names = F.sort_array(F.map_keys("native_components"))
    components = F.map_from_entries(F.transform(names, lambda n: component(F.struct(n.alias("key"), c("native_components")[n].alias("value")))))
    data = F.concat(
        F.lit('{"external_resource_digests":'), F.to_json(ordered_map(c("external_resource_digests"))), F.lit(',"native_components":'), F.to_json(components), F.lit(',"schema_version":'), c("schema_version").cast("string"),
        F.lit(',"settings":'), c("settings"), F.lit(',"wrapper_digest":"'), c("wrapper_digest"), F.lit('"}'),
    )
    text = F.concat(F.lit('{"cpu_cores":'), c("cpu_cores").cast("string"), F.lit(',"evidence_semantic_digests":'), F.to_json("evidence"), F.lit(',"gpu_count":'), c("gpu_count").cast("string"), F.lit(',"prepared":'), data, F.lit("}"))
    judged = prepared.withColumn("first_reason", reason)
    reasons = F.when(F.col("first_reason").isNull(), F.array().cast("array<string>")).otherwise(F.array("first_reason"))
    return with_fingerprint(judged, "identity", domain_digest(domain, text), reasons).drop("first_reason")


def task_recipe(tasks: DataFrame, by: list[str], parts: list[str], strong: dict[str, str], inputs: str = "inputs", domain: str = f"{PREFIX}.recipe.v1") -> DataFrame:
    """``tasks`` with ``recipe``: a digest over ``parts`` and the ordered input identities.

    ``strong`` maps columns that must hold digests to the reason their lack gives; reasons accumulate.
    Whatever isn't in ``parts`` (task ids, retries, locations, memory) can't change the recipe.
    """
    reasons = F.array_compact(
        F.array(*[F.when(~F.coalesce(is_digest(F.col(c)), F.lit(False)), F.lit(r)) for c, r in strong.items()], F.when(F.col(inputs).isNull(), F.lit("INPUT_WEAK")))
    )
    text = canonical(inputs=F.col(inputs), **{p: F.col(p) for p in parts}, **{c: F.col(c) for c in strong})
    return with_fingerprint(tasks, "recipe", domain_digest(domain, text), reasons)


def workflow_recipe(tasks: DataFrame, domain: str = f"{PREFIX}.recipe.v1") -> DataFrame:
    """``tasks`` with ``recipe``: the digest of everything that determines a task's result, in thirteen parts.

    Columns: core_semantics_revision, engine_code_identity, operation_id, operation_api_version,
    validator_revision, plugin_kind, plugin_id, plugin_api_version, plugin_implementation_identity,
    semantic_execution_identity, ``parameters`` (canonical JSON), parameters_verified, ``inputs`` (of
    :func:`input_identities`) and ``outputs`` (array of port, schema_id, schema_version, profile_id,
    profile_version, count). Weak identities and inputs are reasons that add up; parameters that aren't
    verified are one only where there is no other.
    """
    c = F.col
    weak = lambda name, reason: F.when(~F.coalesce(is_digest(c(name)), F.lit(False)), F.lit(reason))
    reasons = F.array_compact(
        F.array(
            weak("engine_code_identity", "ENGINE_IDENTITY_WEAK"), weak("plugin_implementation_identity", "IMPLEMENTATION_IDENTITY_WEAK"), weak("semantic_execution_identity", "EXECUTION_IDENTITY_WEAK"),
            F.when(c("inputs").isNull(), F.lit("INPUT_IDENTITY_WEAK")),
        )
    )
    reasons = F.when((F.size(reasons) == 0) & ~F.coalesce("parameters_verified", F.lit(False)), F.array(F.lit("PARAMETERS_UNVERIFIED"))).otherwise(reasons)
    names = ["core_semantics_revision", "engine_code_identity", "operation_id", "operation_api_version", "plugin_kind", "plugin_id", "plugin_api_version", "plugin_implementation_identity", "semantic_execution_identity"]
    head = canonical(declared_output_contracts=c("outputs"), ordered_input_ports=c("inputs"), **{n: c(n) for n in names})
    text = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"validated_semantic_parameters":'), c("parameters"), F.lit(',"validator_revision":'), canonical(v=c("validator_revision")).substr(F.lit(6), F.length(canonical(v=c("validator_revision")))  - 6), F.lit("}"))
    return with_fingerprint(tasks, "recipe", domain_digest(domain, text), reasons)


def content_digest(products: DataFrame, key: str | list[str], parts: list[str], needed: str, domain: str = f"{PREFIX}.product.content.v1") -> DataFrame:
    """``(key, content_digest)`` over ``parts``; null if any of the array ``needed`` isn't a digest. ``key`` may be several columns."""
    ok = F.forall(needed, lambda d: F.coalesce(is_digest(d), F.lit(False)))
    keys = [key] if isinstance(key, str) else key
    return products.select(*keys, F.when(ok, domain_digest(domain, canonical(needed=F.col(needed), **{p: F.col(p) for p in parts}))).alias("content_digest"))


def artifact_digest(records: DataFrame, recipe: str = "recipe", port: str = "port", inputs: str = "inputs", content: str = "content_digest", domain: str = f"{PREFIX}.artifact.v1") -> DataFrame:
    """``records`` with ``identity``: recipe, port, ordered inputs and content; weak parts are reasons."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(is_digest(F.col(recipe)), F.lit(False)), F.lit("RECIPE_WEAK")),
            F.when(F.col(inputs).isNull(), F.lit("INPUT_WEAK")),
            F.when(~F.coalesce(is_digest(F.col(content)), F.lit(False)), F.lit("CONTENT_WEAK")),
        )
    )
    text = canonical(content=F.col(content), inputs=F.col(inputs), port=F.col(port), recipe=F.col(recipe))
    return with_fingerprint(records, "identity", domain_digest(domain, text), reasons)


def plan_digest(tasks: DataFrame, plan: str, task: str, parts: list[str], declared: str | None = None, domain: str = f"{PREFIX}.plan.v1") -> DataFrame:
    """``(plan, plan_digest[, verified])`` over tasks sorted by id; order inside array parts is the caller's."""
    text = F.to_json(F.struct(F.col(task).alias("task"), *[F.col(p) for p in parts]), {"ignoreNullFields": "false"})
    out = streamed_digest(tasks, [plan], [task, *parts], text, domain, ["[", "]"]).select(plan, F.col("digest").alias("plan_digest"))
    if not declared:
        return out
    said = tasks.groupBy(F.col(plan).alias("of")).agg(F.first(declared).alias("declared"))
    return out.join(said, F.col(plan).eqNullSafe(F.col("of")), "left").select(plan, "plan_digest", F.coalesce(F.col("plan_digest") == F.col("declared"), F.lit(False)).alias("verified"))


#: Fields of a task that stand in its plan as they are.
TASK_FIELDS = ["schema_version", "plugin_ref", "operation_id", "operation_api_version", "resources", "retry_policy", "restart_safety", "cache_policy"]
PLAN_SCHEMA, TASK_SCHEMA, PLAN_VERSION = f"{PREFIX}:workflow-plan", f"{PREFIX}:task-spec", 1


def workflow_plan_digest(tasks: DataFrame, inputs: DataFrame, outputs: DataFrame, externals: DataFrame, declared: DataFrame | None = None, domain: str = f"{PREFIX}.plan.v1") -> DataFrame:
    """``(plan_id, plan_digest, n_tasks, verified)`` of whole plans, from the rows they consist of, in whatever order those come.

    ``tasks``: plan_id, task_id, ``parameters`` (JSON) and the columns :data:`TASK_FIELDS`. ``inputs``: plan_id, task_id, port,
    ord and the source, either ``artifact`` (struct) or src_task and src_port. ``outputs``: plan_id, task_id, port, schema_id,
    schema_version, profile_id, profile_version, count. ``externals``: plan_id, ``artifact``. Tasks stand by id, outputs by port,
    externals by record id; ports stand by name and their inputs in the order of ``ord``, which counts. Objects have
    their keys in order. ``declared``: plan_id, plan_digest; ``verified`` tells whether that is the one worked out. Plans without
    a task have no row, and a plan with parameters that aren't JSON has no digest.

    A task's own ports are put together per task; the plan is then hashed row by row, however many tasks it has.
    """
    key = ["plan_id", "task_id"]
    artifact = canonical_text(inputs, F.struct("artifact", F.lit("artifact").alias("kind")))
    output = canonical_text(inputs, F.struct(F.lit("output").alias("kind"), F.col("src_port").alias("port"), F.col("src_task").alias("task_id")))
    source = F.when(F.col("artifact").isNotNull(), artifact).otherwise(output)
    # dealt once: ports, tasks and the join after it find their rows together
    ports = inputs.select(*key, "port", "ord", source.alias("source")).repartition(*key)
    ports = ports.groupBy(*key, "port").agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("refs"))
    name = F.to_json(F.array("port"))
    named = F.when(F.col("port").isNull(), F.raise_error(F.lit("an input without a port"))).otherwise(F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":["), F.array_join(F.transform("refs", lambda r: r["source"]), ","), F.lit("]")))
    # ports stand in the order of a VARIANT's keys
    row = F.struct(F.encode("port", "UTF-16BE").alias("place"), named.alias("text"))
    ports = ports.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), ",").alias("inputs"))
    names = ["port", "schema_id", "schema_version", "profile_id", "profile_version", "count"]
    made = outputs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("outputs"))
    rows = tasks.select(*key, "parameters", *TASK_FIELDS).join(ports, key, "left").join(made, key, "left")
    said = F.to_json(F.try_parse_json("parameters"))
    own = {"schema_id": F.lit(TASK_SCHEMA), "task_id": F.col("task_id").cast("string"), **{f: F.col(f) for f in TASK_FIELDS}, "outputs": F.coalesce("outputs", F.array().cast(made.schema["outputs"].dataType))}
    texts = {n: F.concat(F.lit(f'"{n}":'), _value(rows, c)) for n, c in own.items()}
    texts |= {"inputs": F.concat(F.lit('"inputs":{'), F.coalesce("inputs", F.lit("")), F.lit("}")), "semantic_parameters": F.concat(F.lit('"semantic_parameters":'), F.coalesce(said, F.lit("null")))}
    whole = F.concat(F.lit("{"), F.concat_ws(",", *[texts[n] for n in sorted(texts)]), F.lit("}"))
    texts = rows.select("plan_id", F.lit(1).alias("part"), F.col("task_id").cast("string").alias("place"), whole.alias("text"), (F.col("parameters").isNull() | said.isNotNull()).alias("good"))
    outer = externals.select("plan_id", F.lit(0).alias("part"), F.col("artifact.record_id").alias("place"), canonical_text(externals, F.col("artifact")).alias("text"), F.lit(True).alias("good"))
    outer = outer.join(tasks.select("plan_id").distinct(), "plan_id", "left_semi")
    openings = ['{"external_inputs":[', f'],"schema_id":"{PLAN_SCHEMA}","schema_version":{PLAN_VERSION},"tasks":[', "]}"]
    out = streamed_digest(texts.unionByName(outer), ["plan_id"], ["place"], F.col("text"), domain, openings, F.col("part"), [F.col("good")])
    counted = tasks.groupBy("plan_id").agg(F.count("*").alias("n_tasks"))
    out = out.join(counted, "plan_id").select("plan_id", F.when(F.col("f0"), F.col("digest")).alias("plan_digest"), "n_tasks")
    if declared is None:
        return out.withColumn("verified", F.lit(None).cast("boolean"))
    said = declared.select("plan_id", F.col("plan_digest").alias("declared"))
    return out.join(said, "plan_id", "left").select("plan_id", "plan_digest", "n_tasks", F.coalesce(F.col("plan_digest") == F.col("declared"), F.lit(False)).alias("verified"))


def invalidated(before: DataFrame, after: DataFrame, keys: list[str], digest: str = "recipe") -> DataFrame:
    """Keys of both sides whose digest differs; null equals null."""
    a, b = before.select(*keys, F.col(digest).alias("was")), after.select(*keys, F.col(digest).alias("now"))
    return a.join(b, keys).where(~F.col("was").eqNullSafe(F.col("now")))
