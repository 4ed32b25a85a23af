"""Readers of record, fact, inventory and settings files, and the append-only writers."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.exprs import path_key
from runloom.sources import listing
from runloom.sources.listing import open_store
from runloom.sources.shared import shared_folder
from runloom.sources.strict import first_fault

#: Largest settings document that is read, in bytes.
MAX_DOCUMENT = 1 << 20
#: Bytes that a file is hashed by.
HASH_BLOCK = 1 << 20
#: Bytes of text that a batch of files is cut at.
TEXT_BATCH = 16 << 20
#: What stands as it is in a path as ``input_file_name`` gives it.
PATH_SAFE = "/:@!$&'()*+,;=~-._"
#: Path parts of the fact kinds below a root; groups are run, and task and attempt where there are such.
FACT_PATHS = {
    "run": r"runs/([^/]+)/run\.json$",
    "started": r"runs/([^/]+)/attempts/([^/]+)/([^/]+)/started\.json$",
    "finished": r"runs/([^/]+)/attempts/([^/]+)/([^/]+)/finished\.json$",
    "receipt": r"runs/([^/]+)/attempts/([^/]+)/([^/]+)/result\.json$",
    "resolution": r"runs/([^/]+)/resolutions/([^/]+)\.json$",
    "summary": r"runs/([^/]+)/summary\.json$",
    "recovery": r"runs/([^/]+)/recovery\.json$",
    "index": r"cache/([^/]+)/([^/]+)\.json$",
    "transition": r"runs/([^/]+)/transitions/([^/]+)\.json$",
}
# The fields of each fact kind's payload, and the version of the envelope around it.
FACT_FIELDS = {
    "run": "run_id scope_id resume_of plan_digest engine_identity implementations source_kind config_refs code_provenance",
    "started": "run_id scope_id task_id attempt_id sequence plan_digest fingerprint execution inputs allocation prepared started_at resolved_inputs",
    "finished": "attempt_id outcome error_code retryable ended_at receipt evidence",
    "receipt": "attempt_id task_id scope_id fingerprint execution inputs outputs cache_policy",
    "resolution": "task_id state disposition receipt error_code blocked_by fingerprint execution cache_reasons",
    "summary": "run_id status states completion_order",
    "recovery": "source_run status attempts",
    "index": "receipt receipt_digest",
    "transition": "task_id state",
}
FACT_VERSION = 2
_IDENTITY = "struct<value:string,reusable:boolean,reasons:array<string>>"
_REF = "struct<record_id:string,schema_id:string,schema_version:bigint,semantic_digest:string,manifest_digest:string,locator:string>"
_INPUTS = "array<struct<port:string,semantic_digests:array<string>>>"
#: Types of the payload fields that are read into columns; free JSON stays a text.
FACT_TYPES = {
    "engine_identity": _IDENTITY, "implementations": f"map<string,{_IDENTITY}>", "config_refs": f"array<{_REF}>", "code_provenance": "struct<package_version:string,source_revision:string>", "sequence": "bigint",
    "inputs": _INPUTS, "allocation": "struct<cpu_cores:bigint,gpu_count:bigint,memory_bytes:bigint>", "started_at": "double", "ended_at": "double", "retryable": "boolean",
    "resolved_inputs": f"map<string,array<struct<artifact:{_REF},manifest_location:string,effective_digest:string,evidence:string>>>", "evidence": "array<string>", "outputs": f"map<string,array<{_REF}>>",
    "blocked_by": "array<string>", "cache_reasons": "array<string>", "states": "map<string,string>", "completion_order": "array<string>", "attempts": "array<struct<attempt_id:string,outcome:string,receipt:string>>",
}
#: Payload values that may be any JSON.
FACT_FREE = frozenset({"prepared", "evidence[]", "resolved_inputs.evidence"})


def fact_schema(kind: str) -> T.StructType:
    """The columns of a fact kind."""
    return T.StructType.fromDDL(", ".join(f"{f} {FACT_TYPES.get(f, 'string')}" for f in FACT_FIELDS[kind].split()))


def parse_records(texts: DataFrame, schema: T.StructType, schema_id: str | None = None, schema_version: int | None = None, text_col: str = "value", source_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON texts.

    Refused, with a code and the path of the first fault and never the payload: text that isn't strict JSON (duplicate
    keys, NaN), fields other than exactly those of ``schema`` at any depth, a boolean where a number is asked and
    the like (:func:`runloom.sources.strict.first_fault`), another schema id or version.
    """
    rows = texts.withColumn("record_variant", F.try_parse_json(F.col(text_col)))
    v = F.col("record_variant")
    fault = F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.struct(F.lit("RECORD_FIELDS").alias("code"), F.lit("$").alias("path"))).otherwise(first_fault(v, schema))
    rows = rows.withColumn("record_fault", fault)
    reason = F.when(v.isNull(), "RECORD_JSON").otherwise(F.col("record_fault.code"))
    if schema_id is not None:
        reason = F.coalesce(reason, F.when(~F.try_variant_get(v, "$.schema_id", "string").eqNullSafe(F.lit(schema_id)), "RECORD_SCHEMA"))
    if schema_version is not None:
        reason = F.coalesce(reason, F.when(~F.try_variant_get(v, "$.schema_version", "int").eqNullSafe(F.lit(schema_version)), "RECORD_VERSION"))
    rows = rows.withColumn("reject_code", reason)
    good = rows.where("reject_code IS NULL").select(source_col, F.from_json(text_col, schema).alias("r")).select(source_col, "r.*")
    return good, rows.where("reject_code IS NOT NULL").select(source_col, "reject_code", F.col("record_fault.path").alias("reject_path"))


def read_records(spark: SparkSession, path: str, schema: T.StructType, schema_id: str | None = None, schema_version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a folder of JSON files, one record each."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return parse_records(texts.withColumn("path", F.input_file_name()), schema, schema_id, schema_version)


def _exact_keys(text: Column, names: list[str]) -> Column:
    keys = F.json_object_keys(text)
    return F.coalesce((F.size(keys) == len(names)) & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0), F.lit(False))


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of each file behind its path; a batch ends at ``TEXT_BATCH`` bytes."""
    for b in batches:
        paths: list[str] = []
        values: list[str] = []
        size = 0
        for root, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, at = open_store(root)
            with store.open_input_stream(f"{at.rstrip('/')}/{path}", compression=None) as f:
                raw = f.read()
            paths.append(f"{root}/{quote(path, safe=PATH_SAFE)}")
            values.append(raw.decode("utf-8", "replace"))
            size += len(raw)
            if size >= TEXT_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["path", "value"])
                paths, values, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["path", "value"])


def fact_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, value`` of every JSON file below ``root``, a table in the shared folder.

    Directories are listed and files are read by tasks, each once, however many there are: nothing of a file goes through the driver.
    As in Spark's readers, names that begin with a point or an underscore are left out. A directory or file that can't be
    read is an error.
    """
    root = re.sub("^file:/+|^/+", "file:///", root.rstrip("/"), count=1)
    found = listing.list_directories(spark.createDataFrame([(0, root)], "dir_id long, root string"))
    shown = ~F.col("path").rlike(r"(^|/)[._]")
    lost = found.where((F.col("kind") == "error") & shown).select("path", "error").limit(1).collect()
    if lost:
        raise OSError(f"{lost[0].error}: {root}/{lost[0].path}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = f"{shared_folder(spark)}/fact-texts-{uuid.uuid4().hex}"
    files = found.where(F.col("kind").isin("file", "link") & shown & F.col("path").endswith(".json")).select("root", "path")
    files.repartition(n, "path").mapInArrow(_read_texts, "path string, value string").write.parquet(to)
    return spark.read.parquet(to)


def read_facts(spark: SparkSession, root: str, kind: str, schema: T.StructType | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, rejects) of one kind below ``root``.

    A file is an envelope of schema_version, kind and payload, with exactly the payload fields of the kind.
    Others are refused by a code and, for values of another type than the kind's schema asks at any depth, their
    path in the payload. Facts carry ``path``, the ids in it (``path_ids``) and ``path_ok``: whether
    those ids are the payload's, tasks standing there as :func:`path_key`. ``texts`` are those of :func:`fact_texts`, where
    several kinds are read from one root.
    """
    texts = fact_texts(spark, root) if texts is None else texts
    schema = schema or fact_schema(kind)
    pattern = FACT_PATHS[kind]
    ids = F.array(*[F.regexp_extract("path", pattern, i) for i in range(1, pattern.count("(") + 1)])
    v = F.try_parse_json("value")
    rows = texts.where(F.col("path").rlike(pattern)).select("path", "value", ids.alias("path_ids"), v.alias("fact_variant"))
    payload = F.to_json(F.variant_get("fact_variant", "$.payload", "variant"))
    version = F.variant_get("fact_variant", "$.schema_version", "variant")
    current = (F.schema_of_variant(version) == "BIGINT") & (F.try_variant_get("fact_variant", "$.schema_version", "int") == FACT_VERSION)
    same = F.try_variant_get("fact_variant", "$.kind", "string") == kind
    reason = (
        F.when(F.col("fact_variant").isNull(), "RECORD_JSON")
        .when(~_exact_keys(F.to_json("fact_variant"), ["schema_version", "kind", "payload"]), "RECORD_FIELDS")
        .when(~F.coalesce(current & same, F.lit(False)), "RUNTIME_RECORD_VERSION_UNSUPPORTED")
        .when(~_exact_keys(payload, FACT_FIELDS[kind].split()), "RECORD_FIELDS")
    )
    fault = first_fault(F.variant_get("fact_variant", "$.payload", "variant"), schema, FACT_FREE)
    rows = rows.select("path", "path_ids", payload.alias("payload"), reason.alias("envelope_code"), F.when(reason.isNull(), fault).alias("fault"))
    rows = rows.select("path", "path_ids", "payload", F.coalesce("envelope_code", "fault.code").alias("reject_code"), F.col("fault.path").alias("reject_path"))
    facts = rows.where("reject_code IS NULL").select("path", "path_ids", F.from_json("payload", schema).alias("r")).select("path", "path_ids", "r.*")
    place = {"run": {"run_id": 0}, "started": {"run_id": 0, "task_id": 1, "attempt_id": 2}, "finished": {"attempt_id": 2}, "receipt": {"task_id": 1, "attempt_id": 2}, "resolution": {"task_id": 1}, "summary": {"run_id": 0}}
    ok = F.lit(True)
    for column, at in place.get(kind, {}).items():
        told = path_key(F.col(column)) if column == "task_id" else F.col(column)
        ok = ok & told.eqNullSafe(F.col("path_ids")[at])
    return facts.withColumn("path_ok", ok), rows.where("reject_code IS NOT NULL").select("path", "reject_code", "reject_path")


def write_fact_files(facts: DataFrame, root: str) -> None:
    """One file per row of ``facts`` (``path`` below ``root``, ``value``), written by the tasks; an empty directory where the value is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, at = pafs.FileSystem.from_uri(f"{re.sub('^file:/+|^/', 'file:///', root)}/{name}")
                store.create_dir(at if value is None else at.rpartition("/")[0], recursive=True)
                if value is None:
                    continue
                with store.open_output_stream(at) as f:
                    f.write(value.encode())
            yield b

    facts.select("path", "value").mapInArrow(run, "path string, value string").write.format("noop").mode("overwrite").save()


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file, read by blocks."""
    for b in batches:
        digests = []
        for uri in b.column(0).to_pylist():
            store, name = pafs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri), safe=":/@[]"))
            h = hashlib.sha256()
            with store.open_input_stream(name) as f:
                while block := f.read(HASH_BLOCK):
                    h.update(block)
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], names=[*b.schema.names, "sha256"])


def read_inventory(spark: SparkSession, root: str, max_bytes: int = 256 << 20) -> DataFrame:
    """``path, kind, size_bytes, sha256, mtime`` of every file below ``root``.

    Spark loads files up to ``max_bytes`` whole; larger ones are listed only, and tasks hash them by blocks
    of ``HASH_BLOCK`` bytes. These are opened by Arrow, and a store that it can't open is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.concat(F.lit(r"^\Q"), F.regexp_replace(base, "^/*", "/"), F.lit(r"\E/?")), "")
    small = files.where(F.col("length") <= max_bytes).select(path.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"))
    large = files.where(F.col("length") > max_bytes).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    large = large.mapInArrow(_hash_files, "path string, size_bytes long, mtime timestamp, sha256 string").select(path.alias("path"), "size_bytes", "sha256", "mtime")
    return small.unionByName(large).select("path", F.lit("file").alias("kind"), "size_bytes", "sha256", "mtime")


def read_config_documents(docs: DataFrame, id_col: str = "config_id", content_col: str = "content") -> DataFrame:
    """``config_id, sha256, size_bytes, text, issue_code`` of settings documents in JSON.

    Documents above ``MAX_DOCUMENT`` bytes or that aren't strict JSON get a code and no text.
    """
    raw = F.col(content_col).cast("binary")
    text = raw.cast("string")
    code = F.when(F.octet_length(raw) > MAX_DOCUMENT, "CONFIG_INPUT").when(F.try_parse_json(text).isNull(), "CONFIG_SYNTAX")
    return docs.select(F.col(id_col).alias("config_id"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("size_bytes"), F.when(code.isNull(), text).alias("text"), code.alias("issue_code"))


def append_facts(new: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts to append, refused facts): keys that exist are never overwritten; of repeats in ``new`` all
    are refused but one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.xxhash64(*new.columns))
    rows = new.withColumn("fact_repeat", F.row_number().over(w))
    known = existing.select(*keys).distinct()
    fresh = rows.join(known, keys, "left_anti")
    ok = fresh.where("fact_repeat = 1").drop("fact_repeat")
    refused = rows.join(known, keys, "left_semi").unionByName(fresh.where("fact_repeat > 1")).drop("fact_repeat")
    return ok.select(*new.columns), refused.select(*new.columns)


def write_resolved(df: DataFrame, path: str) -> None:
    """Exclusive create: an existing target is an error."""
    df.write.mode("errorifexists").parquet(path)


def reuse_index(receipts: DataFrame) -> DataFrame:
    """Index rows of receipts: automatic policy, a strong recipe, every output with a digest.

    ``receipts``: path, fingerprint, cache_policy, output_digests array. A projection, so it can be rebuilt
    from the receipts at any time; a missing index never negates a receipt.
    """
    strong = F.coalesce(F.col("fingerprint").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    whole = F.forall("output_digests", lambda d: d.isNotNull())
    return receipts.where((F.col("cache_policy") == "auto") & strong & whole).select("fingerprint", F.col("path").alias("receipt"), F.substring("fingerprint", 1, 2).alias("recipe_prefix"))


def publish_reuse_index(receipts: DataFrame, path: str) -> None:
    """Append index rows, partitioned by the first digits of the recipe, by which look-ups prune."""
    reuse_index(receipts).write.mode("append").partitionBy("recipe_prefix").parquet(path)
