"""What records say (DIG-8, DIG-9): orders as products, customers as catalogues, events as acquisitions, parts as quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import material as M
from runloom.plans.digests import INPUTS, dsql, inputs
from runloom.plans.registry import Tables, query

REFERENCES = "array<struct<record_id:string,semantic_digest:string>>"


def ref(record_id: Column, digest: Column | None = None) -> Column:
    """A reference as far as it is looked at."""
    return F.struct(record_id.alias("record_id"), (F.lit(None).cast("string") if digest is None else digest).alias("semantic_digest"))


def semantic(value: Column, *evidence: Column, status: str = "known") -> Column:
    proof = F.array(*evidence) if evidence else F.array().cast(REFERENCES)
    return F.struct(F.lit(status).alias("status"), value.alias("value"), F.lit(None).cast("string").alias("reason_code"), proof.alias("evidence_refs"))


def said(value: str, *evidence: str) -> str:
    """SQL of a semantic value once its references are digests."""
    return f"{{'evidence_semantic_digests': [{', '.join(evidence)}], 'reason_code': CAST(NULL AS VARCHAR), 'status': 'known', 'value': {value}}}"


def named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column))


def record_digests(t: Tables) -> DataFrame:
    """Digests of customers, parts and suppliers; every 31st customer and 40th part has none."""
    own = lambda df, prefix, key, weak: df.where(weak).select(named(prefix, key).alias("record_id"), F.sha2(named(prefix, key), 256).alias("semantic_digest"))
    return own(t.customer, "customer", "c_custkey", "c_custkey % 31 <> 0").unionByName(own(t.part, "part", "p_partkey", "p_partkey % 40 <> 0")).unionByName(own(t.supplier, "supplier", "s_suppkey", "true"))


def digest_of(prefix: str, key: str) -> str:
    return f"sha256('{prefix}:' || CAST({key} AS VARCHAR))"


def distinct_lines(t: Tables) -> DataFrame:
    """Lines, dealt by order while they are four numbers."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct().withColumn("asset_id", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"))


def products(t: Tables) -> DataFrame:
    """Orders: a line is an asset, a layer and an ancestor; what it was made with is the order's geometry."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "asset_id")
    nested = distinct_lines(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition("o_orderkey")
    rows = orders.join(nested, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(nested.schema["lines"].dataType)))
    layer = lambda x: F.struct(
        F.concat(F.lit("layer:"), x["asset_id"]).alias("layer_id"), x["asset_id"].alias("asset_id"),
        semantic(F.struct(F.lit("los").alias("convention_id"), F.array(ref(F.concat(F.lit("supplier:"), x["l_suppkey"]))).alias("evidence_refs"))).alias("sign"),
        semantic(F.struct(F.lit("value").alias("kind"), F.lit(-9999.5).alias("value"), F.lit(None).cast("string").alias("mask_layer_ref"))).alias("nodata"),
    )
    customer = ref(named("customer", "o_custkey"))
    axis = F.struct(F.lit("x").alias("axis_id"), F.lit("range").alias("role"), semantic(F.struct(F.lit("m").alias("unit_id"), F.lit("length").alias("quantity_kind"), F.lit(None).cast("string").alias("definition_ref"))).alias("unit"))
    grid = F.struct(F.lit("grid").alias("format_id"), F.concat(F.lit('{"step": 2, "looks": '), F.col("o_custkey") % 4, F.lit("}")).alias("parameters"))
    geometry = F.struct(F.lit("g").alias("geometry_id"), F.array(axis).alias("axes"), F.array(F.size("lines")).alias("shape"), semantic(grid).alias("grid_definition"), semantic(customer, customer, ref(F.lit("x"), F.sha2("o_orderpriority", 256))).alias("reference"))
    return rows.select(
        "o_orderkey", "o_custkey", F.col("o_orderkey").alias("record_id"), F.lit("s:product").alias("schema_id"), F.lit(1).alias("schema_version"), F.col("o_orderstatus").alias("product_kind"), F.lit("p").alias("profile_id"), F.lit(2).alias("profile_version"),
        F.transform("lines", lambda x: F.struct(x["asset_id"].alias("asset_id"), F.lit("file").alias("asset_kind"), F.concat(F.lit("/data/"), x["asset_id"]).alias("location"))).alias("assets"),
        F.array(customer).alias("acquisition_refs"), F.create_map(F.lit("priority"), semantic(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')))).alias("semantic_metadata"),
        F.transform("lines", lambda x: F.struct(F.lit("source").alias("role"), ref(F.concat(F.lit("part:"), x["l_partkey"])).alias("artifact"))).alias("lineage"),
        F.array(geometry).alias("geometries"), F.transform("lines", layer).alias("layers"), F.create_map(F.lit("x:n"), F.concat(F.lit("[ "), F.size("lines"), F.lit(" ]"))).alias("extensions"),
    )


def identities(t: Tables, key: str) -> DataFrame:
    content = F.when(F.col("l_partkey") % 50 != 0, F.sha2("asset_id", 256))
    return distinct_lines(t).select(F.col("l_orderkey").alias(key), "asset_id", content.alias("content_identity"))


PRODUCTS = f"""d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
n AS (SELECT l_orderkey, CAST(count(*) AS INT) AS n, bool_or(l_partkey % 50 = 0) AS weak_asset, bool_or(l_partkey % 40 = 0) AS weak_part,
  list({{'asset_id': id, 'asset_kind': 'file', 'content_identity': sha256(id)}} ORDER BY l_linenumber, l_partkey, l_suppkey, id) AS assets,
  list({{'artifact_semantic_digest': {digest_of("part", "l_partkey")}, 'role': 'source'}} ORDER BY l_linenumber, l_partkey, l_suppkey, id) AS lineage,
  list({{'asset_id': id, 'layer_id': 'layer:' || id, 'nodata': {said("{'kind': 'value', 'mask_layer_ref': CAST(NULL AS VARCHAR), 'value': CAST(-9999.5 AS DOUBLE)}")},
    'sign': {said("{'convention_id': 'los', 'evidence_semantic_digests': [" + digest_of("supplier", "l_suppkey") + "]}")}}} ORDER BY l_linenumber, l_partkey, l_suppkey, id) AS layers,
  '{{' || string_agg('"' || id || '":"' || sha256(id) || '"', ',' ORDER BY id) || '}}' AS ids FROM d GROUP BY l_orderkey),
m AS (SELECT o_orderkey, o_custkey, coalesce(ids, '{{}}') AS ids, CASE WHEN weak_asset THEN 'ASSET_WEAK' WHEN o_custkey % 31 = 0 OR weak_part THEN 'REFERENCE_WEAK' END AS reason,
  CAST(to_json({{'extensions': {{'x:n': [coalesce(n, 0)]}}, 'product': {{'acquisition_semantic_digests': [{digest_of("customer", "o_custkey")}], 'assets': coalesce(assets, []), 'geometries': [{{
    'axes': [{{'axis_id': 'x', 'role': 'range', 'unit': {said("{'definition_ref': CAST(NULL AS VARCHAR), 'quantity_kind': 'length', 'unit_id': 'm'}")}}}],
    'geometry_id': 'g', 'grid_definition': {said("{'format_id': 'grid', 'parameters': {'looks': o_custkey % 4, 'step': 2}}")},
    'reference': {said(digest_of("customer", "o_custkey"), digest_of("customer", "o_custkey"), "sha256(o_orderpriority)")}, 'shape': [coalesce(n, 0)]}}],
    'layers': coalesce(layers, []), 'lineage': coalesce(lineage, []), 'product_kind': o_orderstatus, 'profile_id': 'p', 'profile_version': 2, 'semantic_metadata': {{'priority': {said("o_orderpriority")}}}}},
    'schema_id': 'runloom:product-semantic-material', 'schema_version': 1}}) AS VARCHAR) AS material FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@query(f"WITH {PRODUCTS} SELECT o_orderkey, CASE WHEN reason IS NULL THEN " + dsql(M.CONTENT_DOMAIN, "material") + " END AS content_digest, reason FROM m")
def dig8_content_material(t: Tables) -> DataFrame:
    return M.product_content(products(t), "o_orderkey", record_digests(t), identities(t, "o_orderkey"))


def producers(rows: DataFrame, kind: str, number: Column, given: DataFrame | None = None) -> DataFrame:
    """Recipes of records; by their number every 17th is weak and every 23rd has no proper port."""
    recipe = F.when(number % 17 == 0, "weak").otherwise(F.sha2(F.concat(F.lit("r"), F.col("record_id").cast("string")), 256))
    out = rows.select("record_id", F.lit(kind).alias("record_type"), recipe.alias("recipe"), F.when(number % 23 == 0, " ").otherwise("out").alias("port"))
    none = F.array().cast("array<struct<port:string,semantic_digests:array<string>>>")
    return out.withColumn("inputs", none) if given is None else out.join(given, "record_id", "left").withColumn("inputs", F.col("inputs"))


def identified(t: Tables, kind: str, rows: DataFrame, number: Column, given: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    out = M.artifact_identity({kind: rows}, producers(rows, kind, number, given), record_digests(t), assets)
    return out.select(F.col("record_id"), "identity.value", F.array_join("identity.reasons", ",").alias("reasons"), "refused")


def result_sql(source: str, key: str, number: str, schema: str, profile: str, weak: str, inputs_json: str = "CAST('[]' AS JSON)", ids: str = "'{}'", unknown_inputs: str = "false") -> str:
    """Identities of the rows of ``source``, which has ``material`` text, a key and a number."""
    whole = f"""to_json({{'ordered_input_lineage': {inputs_json}, 'output_port': 'out', 'producer_task_fingerprint': sha256('r' || CAST({key} AS VARCHAR)), {profile}, 'schema_id': '{schema}', 'schema_version': 1, 'scientific_asset_content_identities': CAST({ids} AS JSON), 'typed_semantic_projection': CAST(material AS JSON)}})"""
    return f"""SELECT CAST({key} AS VARCHAR) AS record_id, CASE WHEN refused IS NULL AND reasons = '' THEN {dsql(M.ARTIFACT_DOMAIN, f"CAST({whole} AS VARCHAR)")} END AS value, CASE WHEN refused IS NULL THEN reasons END AS reasons, refused
FROM (SELECT *, CASE WHEN {number} % 23 = 0 THEN 'RESULT_OUTPUT_PORT' END AS refused, CASE WHEN {number} % 17 = 0 THEN 'RESULT_RECIPE_WEAK' WHEN {unknown_inputs} THEN 'RESULT_INPUT_IDENTITY_WEAK' WHEN {weak} THEN 'RESULT_CONTENT_IDENTITY_WEAK' ELSE '' END AS reasons FROM {source})"""


NO_PROFILE = "'profile_id': CAST(NULL AS VARCHAR), 'profile_version': CAST(NULL AS INT)"


@query(f"WITH {INPUTS}, {PRODUCTS} " + result_sql("(SELECT m.*, r.inputs FROM m LEFT JOIN r ON r.l_orderkey = o_orderkey)", "o_orderkey", "o_custkey", "s:product", "'profile_id': 'p', 'profile_version': 2", "reason IS NOT NULL", "CAST(inputs AS JSON)", "ids", "inputs IS NULL"))
def dig9_product_identity(t: Tables) -> DataFrame:
    given = inputs(t).select(F.col("l_orderkey").alias("record_id"), "inputs")
    return identified(t, "product", products(t), F.col("o_custkey"), given, identities(t, "record_id"))


PLUGIN = "{'api_version': 1, 'kind': 'catalog', 'plugin_id': 'shop'}"


@query(f"""WITH e AS (SELECT o_custkey, bool_or(o_custkey % 31 = 0) AS weak, list({{'access': {{'access_required': o_orderkey % 2 = 0, 'availability': o_orderstatus, 'delivery': 'direct', 'reason_code': CAST(NULL AS VARCHAR)}}, 'attributes': {{'priority': o_orderpriority}}, 'entry_id': CAST(o_orderkey AS VARCHAR), 'evidence_semantic_digests': [{digest_of("customer", "o_custkey")}]}} ORDER BY o_orderkey) AS entries FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey, coalesce(weak, false) AS weak, CAST(to_json({{'entries': coalesce(entries, []), 'extensions': {{'x:segment': {{'name': c_mktsegment}}}}, 'provider': {PLUGIN}, 'query_schema_id': 'q', 'query_schema_version': 1, 'selectors': {{'nation': c_nationkey}}}}) AS VARCHAR) AS material FROM customer LEFT JOIN e ON o_custkey = c_custkey)
""" + result_sql("c", "c_custkey", "c_custkey", "s:catalog", NO_PROFILE, "weak"))
def dig9_catalog_identity(t: Tables) -> DataFrame:
    access = F.struct(F.col("o_orderstatus").alias("availability"), F.lit("direct").alias("delivery"), (F.col("o_orderkey") % 2 == 0).alias("authentication_required"), F.lit(None).cast("string").alias("reason_code"))
    entry = F.struct(F.col("o_orderkey").alias("place"), F.struct(F.col("o_orderkey").cast("string").alias("entry_id"), access.alias("access"), F.concat(F.lit('{"priority":"'), F.col("o_orderpriority"), F.lit('"}')).alias("attributes"), F.array(ref(named("customer", "o_custkey"))).alias("evidence_refs")).alias("entry"))
    entries = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("entries"))
    rows = t.customer.join(entries, "c_custkey", "left").withColumn("entries", F.coalesce("entries", F.array().cast(entries.schema["entries"].dataType)))
    provider = F.struct(F.lit("catalog").alias("kind"), F.lit("shop").alias("plugin_id"), F.lit(1).alias("api_version"))
    rows = rows.select(
        "c_custkey", F.col("c_custkey").alias("record_id"), F.lit("s:catalog").alias("schema_id"), F.lit(1).alias("schema_version"), provider.alias("provider"), F.lit("q").alias("query_schema_id"), F.lit(1).alias("query_schema_version"),
        F.concat(F.lit('{ "nation": '), F.col("c_nationkey"), F.lit(" }")).alias("selectors"), "entries", F.create_map(F.lit("x:segment"), F.concat(F.lit('{"name": "'), F.col("c_mktsegment"), F.lit('"}'))).alias("extensions"),
    )
    return identified(t, "catalog", rows, F.col("c_custkey"))


@query(f"""WITH a AS (SELECT event_id, user_id, CAST(to_json({{'attributes': {{'props': {said("json(props)")}, 'type': {said("event_type", digest_of("customer", "1 + user_id % 1000"))}}}, 'evidence_semantic_digests': [sha256(event_type)], 'extensions': {{'x:user': user_id}}, 'mission': {PLUGIN.replace("catalog", "mission").replace("shop", "web")}, 'source_semantic_digest': {digest_of("customer", "1 + event_id % 1000")}}}) AS VARCHAR) AS material FROM events)
""" + result_sql("a", "event_id", "user_id", "s:acquisition", NO_PROFILE, "(1 + event_id % 1000) % 31 = 0 OR (1 + user_id % 1000) % 31 = 0 OR (1 + event_id % 1000) > (SELECT max(c_custkey) FROM customer) OR (1 + user_id % 1000) > (SELECT max(c_custkey) FROM customer)"))
def dig9_acquisition_identity(t: Tables) -> DataFrame:
    of = lambda c: F.concat(F.lit("customer:"), 1 + F.col(c) % 1000)
    attributes = F.create_map(F.lit("type"), semantic(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), ref(of("user_id"))), F.lit("props"), semantic(F.col("props")))
    mission = F.struct(F.lit("mission").alias("kind"), F.lit("web").alias("plugin_id"), F.lit(1).alias("api_version"))
    events = t.events.select("event_id", "user_id", "event_type", "props").repartition("event_id")
    rows = events.select(
        "user_id", F.col("event_id").alias("record_id"), F.lit("s:acquisition").alias("schema_id"), F.lit(1).alias("schema_version"), ref(of("event_id")).alias("source_ref"), mission.alias("mission"), attributes.alias("attributes"),
        F.array(ref(F.lit("x"), F.sha2("event_type", 256))).alias("evidence_refs"), F.create_map(F.lit("x:user"), F.col("user_id").cast("string")).alias("extensions"),
    )
    return identified(t, "acquisition", rows, F.col("user_id"))


@query(f"""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), i AS (SELECT l_partkey, list({digest_of("supplier", "l_suppkey")} ORDER BY l_suppkey) AS refs FROM s GROUP BY l_partkey),
q AS (SELECT p_partkey, CAST(to_json({{'extensions': {{'x:brand': p_brand}}, 'findings': CASE WHEN p_size > 25 THEN [{{'details': {{'size': p_size}}, 'finding_code': 'LARGE'}}] ELSE [] END, 'input_semantic_digests': coalesce(refs, []), 'method_id': 'm', 'method_version': '1',
  'metrics': [{{'details': [1, 2], 'metric_id': 'size', 'unit': {said("{'unit_id': 'cm'}")}, 'value': {said("{'source_semantic_digest': " + digest_of("part", "p_partkey") + ", 'value': p_size}")}}}], 'status': CASE WHEN p_size > 25 THEN 'warn' ELSE 'pass' END}}) AS VARCHAR) AS material FROM part LEFT JOIN i ON l_partkey = p_partkey)
""" + result_sql("q", "p_partkey", "p_partkey", "s:quality", NO_PROFILE, "p_partkey % 40 = 0"))
def dig9_quality_identity(t: Tables) -> DataFrame:
    made = t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("suppliers"))
    rows = t.part.join(made, "p_partkey", "left").withColumn("suppliers", F.coalesce("suppliers", F.array().cast("array<bigint>")))
    value = semantic(F.struct(F.col("p_size").alias("value"), ref(named("part", "p_partkey")).alias("source_ref")))
    metric = F.struct(F.lit("size").alias("metric_id"), value.alias("value"), semantic(F.struct(F.lit("cm").alias("unit_id"))).alias("unit"), F.lit("[1,\n2]").alias("details"))
    finding = F.struct(F.lit("LARGE").alias("finding_code"), F.concat(F.lit('{"size":'), F.col("p_size"), F.lit("}")).alias("details"))
    large = F.col("p_size") > 25
    rows = rows.select(
        "p_partkey", F.col("p_partkey").alias("record_id"), F.lit("s:quality").alias("schema_id"), F.lit(1).alias("schema_version"), F.when(large, "warn").otherwise("pass").alias("status"), F.lit("m").alias("method_id"), F.lit("1").alias("method_version"),
        F.transform("suppliers", lambda s: ref(F.concat(F.lit("supplier:"), s))).alias("input_refs"), F.array(metric).alias("metrics"), F.filter(F.array(F.when(large, finding)), lambda f: f.isNotNull()).alias("findings"),
        F.create_map(F.lit("x:brand"), F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).alias("extensions"),
    )
    return identified(t, "quality", rows, F.col("p_partkey"))
