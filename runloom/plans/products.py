"""Product-record checks (PRD) and readers (SRC) over lineitems, events, embeddings, parts, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators import products as P
from runloom.plans.registry import Tables, query
from runloom.sources import records

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def orders_with_lines(t: Tables) -> DataFrame:
    """Orders as nested records: lines are assets, in order."""
    line = F.struct(F.col("l_linenumber").alias("asset_id"), "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_returnflag").alias("asset_kind"))
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("product_id")).agg(F.array_sort(F.collect_list(line)).alias("assets"))
    return nested.withColumn("extensions", F.create_map(F.lit("n"), F.size("assets").cast("string")))


RANKED = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {CENTS} AS cents, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {CENTS}, l_returnflag) - 1 AS pos FROM lineitem"


@query(f"SELECT l_orderkey AS product_id, pos, l_linenumber AS asset_id, l_partkey, l_suppkey, cents, l_returnflag AS asset_kind FROM ({RANKED})")
def prd1_explode_products(t: Tables) -> DataFrame:
    return P.explode_products(orders_with_lines(t))["assets"]


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'duplicate-asset-id' AS code, CAST(pos AS VARCHAR) AS location FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS nth FROM ({RANKED})) WHERE nth > 1")
def prd2_check_duplicates(t: Tables) -> DataFrame:
    rows = P.explode_products(orders_with_lines(t))["assets"]
    return P.check_duplicates(rows, "product_id", ["asset_id"], ["pos"], "duplicate-asset-id")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS subject_id, 'error' AS kind, 'missing-label' AS code, d.source AS location FROM documents d WHERE d.lang <> 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def prd3_check_references(t: Tables) -> DataFrame:
    return P.check_references(t.documents, t.labels, {"doc_id": "doc_id"}, "doc_id", "source", "missing-label", F.col("lang") != "en")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, code, 'l1' AS location FROM (
SELECT o_orderkey, 'missing-asset-reference' AS code FROM orders WHERE o_custkey % 4 = 0
UNION ALL SELECT o_orderkey, 'missing-geometry-reference' FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'missing-mask-layer-reference' FROM orders WHERE o_custkey % 5 = 0)""")
def prd3_check_layers(t: Tables) -> DataFrame:
    """Two layers an order: the first names an asset, a geometry and a mask, the second nothing but the asset."""
    product, c = F.col("o_orderkey").alias("product_id"), F.col("o_custkey")
    known = lambda when, **fields: F.struct(F.when(when, "known").otherwise("unknown").alias("status"), *[v.alias(k) for k, v in fields.items()])
    mask = lambda when, ref: known(when, value=F.struct(F.lit("mask").alias("kind"), ref.alias("mask_layer_ref")))
    first = t.orders.select(product, F.lit("l1").alias("layer_id"), F.when(c % 4 == 0, "x").otherwise("a").alias("asset_id"), known(c % 2 == 0, value=F.lit("g")).alias("geometry_ref"), mask(F.lit(True), F.when(c % 5 == 0, "zz").otherwise("l2")).alias("nodata"))
    second = t.orders.select(product, F.lit("l2").alias("layer_id"), F.lit("a").alias("asset_id"), known(F.lit(False), value=F.lit("g")).alias("geometry_ref"), mask(F.lit(False), F.lit("zz")).alias("nodata"))
    assets = t.orders.select(product, F.lit("a").alias("asset_id"))
    geometries_ = t.orders.where("o_orderkey % 3 > 0").select(product, F.lit("g").alias("geometry_id"))
    return P.check_layers(first.unionByName(second), assets, geometries_)


@query("""SELECT CAST(vec_id AS VARCHAR) AS subject_id, 'error' AS kind, code, CAST(vec_id AS VARCHAR) AS location FROM (
  SELECT vec_id, CASE WHEN len(embedding) <> 63 + vec_id % 2 THEN 'geometry-axis-count-mismatch' END AS code FROM embeddings
  UNION ALL SELECT vec_id, CASE WHEN label = 0 THEN 'invalid-geometry-shape' END FROM embeddings
  UNION ALL SELECT vec_id, CASE WHEN len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 2) AS BIGINT)))) < len(embedding) THEN 'duplicate-axis-id' END FROM embeddings) WHERE code IS NOT NULL""")
def prd4_check_geometry(t: Tables) -> DataFrame:
    return P.check_geometry(geometries(t), "vec_id", "vec_id", "embedding", "shape", F.transform("embedding", lambda x: F.floor(x * 2)))


def geometries(t: Tables) -> DataFrame:
    size = F.when(F.col("label") == 0, 0).otherwise(1)
    return t.embeddings.withColumn("shape", F.array_repeat(size, (F.col("vec_id") % 2).cast("int") + 63))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS subject_id, 'error' AS kind, 'layer-dimensions-geometry-mismatch' AS code, CAST(o_orderkey AS VARCHAR) AS location FROM orders
WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'O' AND o_custkey % 3 <> 0""")
def prd5_check_dimensions(t: Tables) -> DataFrame:
    axes = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("y"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    geometry = t.orders.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("geometry_id"), axes.alias("axis_ids"))
    dims = F.when(F.col("o_custkey") % 3 == 0, F.when(F.col("o_orderstatus") == "O", F.array(F.lit("y"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))).otherwise(F.array(F.lit("y"), F.lit("x")))
    layers = t.orders.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").alias("layer_id"), F.col("o_orderkey").alias("geometry_id"), dims.alias("dimensions"))
    bad = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderkey").cast("string").alias("location"))
    return P.check_dimensions(layers, geometry, bad)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'asset-requirement-unsatisfied' AS code, requirement_id AS location, count(l_orderkey) AS observed_count
FROM orders CROSS JOIN (VALUES ('returned', 'R', 1, 3), ('kept', 'NA', 2, 5), ('any', 'NAR', 1, NULL)) AS r(requirement_id, kinds, min_count, max_count)
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND contains(kinds, l_returnflag) GROUP BY o_orderkey, requirement_id, min_count, max_count HAVING count(l_orderkey) < min_count OR count(l_orderkey) > max_count""")
def prd6_check_cardinality(t: Tables) -> DataFrame:
    rows = [("p", 1, "returned", ["R"], 1, 3), ("p", 1, "kept", ["N", "A"], 2, 5), ("p", 1, "any", [], 1, None)]
    asked = t.spark.createDataFrame(rows, "profile_id string, profile_version int, requirement_id string, allowed_kinds array<string>, min_count int, max_count int")
    orders = t.orders.select(F.col("o_orderkey").alias("product_id"), F.lit("p").alias("profile_id"), F.lit(1).alias("profile_version"))
    members = t.lineitem.select(F.col("l_orderkey").alias("product_id"), F.col("l_returnflag").alias("asset_kind"))
    return P.check_cardinality(orders, asked, members, P.asset_matches(), "asset-requirement-unsatisfied")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (
SELECT o_orderkey, 'profile-id-mismatch' AS code, 'profile_id' AS location FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'profile-version-mismatch', 'profile_version' FROM orders WHERE o_custkey % 4 = 0
UNION ALL SELECT o_orderkey, 'product-kind-not-allowed', 'product_kind' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'O')""")
def prd6_check_profile(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    rows = t.orders.select(F.col("o_orderkey").alias("product_id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("expected_profile"), F.col("o_orderstatus").alias("product_kind"), F.when(c % 4 == 0, 1).otherwise(2).alias("profile_version"))
    rows = rows.join(t.orders.select(F.col("o_orderkey").alias("product_id"), (c % 3 == 0).alias("astray")), "product_id").withColumn("profile_id", F.when(F.col("astray"), "else").otherwise(F.col("expected_profile")))
    profiles = t.spark.createDataFrame([("even", 2, ["O"]), ("odd", 2, [])], "profile_id string, profile_version int, allowed_product_kinds array<string>")
    return P.check_profile(rows, profiles)


GEOMETRY = """g AS (SELECT l_orderkey AS p, l_linestatus AS domain, CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE 'xy' END AS axes, l_partkey % 2 = 0 AS registered, l_suppkey % 2 = 0 AS referenced FROM lineitem)"""


@query(f"""WITH {GEOMETRY}, n AS (SELECT o_orderkey, requirement_id, low, high, count(g.p) AS observed_count
FROM orders CROSS JOIN (VALUES ('domain', 'O', '', false, false, 1, NULL), ('axes', NULL, 'y', false, false, 1, 3), ('known', NULL, 'x', true, true, 0, 1)) AS r(requirement_id, domain, role, registration, reference, low, high)
LEFT JOIN g ON g.p = o_orderkey AND (r.domain IS NULL OR g.domain = r.domain) AND contains(axes, role) AND (NOT registration OR registered) AND (NOT reference OR referenced) GROUP BY 1, 2, 3, 4)
SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'geometry-requirement-unsatisfied' AS code, requirement_id AS location, observed_count FROM n WHERE observed_count < low OR observed_count > high""")
def prd6_geometry_requirements(t: Tables) -> DataFrame:
    rows = [("p", 1, "domain", "O", [], False, False, 1, None), ("p", 1, "axes", None, ["y"], False, False, 1, 3), ("p", 1, "known", None, ["x"], True, True, 0, 1)]
    asked = t.spark.createDataFrame(rows, "profile_id string, profile_version int, requirement_id string, domain_id string, required_axis_roles array<string>, require_known_registration boolean, require_known_coordinate_reference boolean, min_count int, max_count int")
    status = lambda c: F.when(F.col(c) % 2 == 0, "known").otherwise("unknown")
    axes = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    members = t.lineitem.select(F.col("l_orderkey").alias("product_id"), F.col("l_linestatus").alias("domain"), axes.alias("axis_roles"), status("l_partkey").alias("registration_status"), status("l_suppkey").alias("coordinate_reference_status"))
    orders = t.orders.select(F.col("o_orderkey").alias("product_id"), F.lit("p").alias("profile_id"), F.lit(1).alias("profile_version"))
    return P.check_cardinality(orders, asked, members, P.geometry_matches(), "geometry-requirement-unsatisfied")


@query("""WITH m AS (SELECT l_orderkey AS p, l_returnflag AS role, CASE WHEN l_linenumber % 4 > 0 THEN l_linestatus END AS selector, l_partkey % 2 = 0 AS known, l_partkey % 3 AS value, l_suppkey % 2 = 0 AS placed, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END AS domain FROM lineitem),
r AS (SELECT * FROM (VALUES ('role', 'R', NULL, false, NULL, false, NULL, 0, 1), ('selector', NULL, 'O', false, NULL, false, NULL, 1, 4), ('quantity', NULL, NULL, true, 1, false, NULL, 0, 0), ('geometry', NULL, NULL, false, NULL, true, 'F', 1, NULL)) AS r(requirement_id, role, selector, quantity, value, geometry, domain, low, high)),
n AS (SELECT o_orderkey, r.requirement_id, low, high, count(m.p) AS observed_count FROM orders CROSS JOIN r LEFT JOIN m ON m.p = o_orderkey AND (r.role IS NULL OR m.role = r.role) AND (r.selector IS NULL OR m.selector = r.selector) AND (NOT quantity OR known) AND (r.value IS NULL OR (known AND m.value = r.value)) AND (NOT geometry OR placed) AND (r.domain IS NULL OR m.domain = r.domain) GROUP BY 1, 2, 3, 4)
SELECT CAST(o_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'layer-requirement-unsatisfied' AS code, requirement_id AS location, observed_count FROM n WHERE observed_count < low OR observed_count > high""")
def prd6_layer_requirements(t: Tables) -> DataFrame:
    names = "profile_id string, profile_version int, requirement_id string, role string, selector_kind string, require_known_quantity boolean, quantity_kind string, require_known_unit boolean, unit_id string, require_known_sign boolean, sign_convention_id string, require_known_geometry boolean, geometry_domain_id string, min_count int, max_count int"
    no = (False, None, False, None)
    rows = [("p", 1, "role", "R", None, False, None, *no, False, None, 0, 1), ("p", 1, "selector", None, "O", False, None, *no, False, None, 1, 4), ("p", 1, "quantity", None, None, True, "1", *no, False, None, 0, 0), ("p", 1, "geometry", None, None, False, None, *no, True, "F", 1, None)]
    known = F.when(F.col("l_partkey") % 2 == 0, "known").otherwise("unknown")
    placed = F.col("l_suppkey") % 2 == 0
    same = [x for f in ("unit", "sign") for x in (known.alias(f"{f}_status"), F.lit("v").alias(f"{f}_value"))]
    members = t.lineitem.select(
        F.col("l_orderkey").alias("product_id"), F.col("l_returnflag").alias("role"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_linestatus")).alias("selector_format"), known.alias("quantity_status"), (F.col("l_partkey") % 3).cast("string").alias("quantity_value"), *same,
        F.when(placed, "known").otherwise("unknown").alias("geometry_status"), F.when(placed, F.col("l_linestatus")).alias("geometry_domain"),
    )
    orders = t.orders.select(F.col("o_orderkey").alias("product_id"), F.lit("p").alias("profile_id"), F.lit(1).alias("profile_version"))
    return P.check_cardinality(orders, t.spark.createDataFrame(rows, names), members, P.layer_matches(), "layer-requirement-unsatisfied")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, 'error' AS kind, 'lineage-conflict' AS code, l_linestatus || ':' || CAST(l_partkey AS VARCHAR) AS location FROM lineitem GROUP BY l_orderkey, l_linestatus, l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def prd8_check_lineage(t: Tables) -> DataFrame:
    return P.check_lineage(t.lineitem, "l_orderkey", "l_linestatus", "l_partkey", F.col("l_suppkey"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'schema-mismatch' END AS code, 'schema_id' AS location FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'version-mismatch' END, 'schema_version' FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 OR (p_partkey % 3 = 1 AND contains(p_type, ' ')) THEN 'producer-identity' END, 'execution' FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'extension-key' END, 'extensions' FROM part) WHERE code IS NOT NULL""")
def prd9_check_envelope(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 3
    rows = t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 11 == 0, "other").otherwise("runloom:product").alias("schema_id"),
        F.when(F.col("p_size") % 2 == 0, 1).otherwise(2).alias("schema_version"),
        F.when(m == 0, "known").when(m == 1, "unknown").otherwise("not_applicable").alias("execution_status"),
        F.when(m == 0, F.col("p_brand")).alias("execution_value"),
        F.when(m == 1, F.col("p_type")).alias("execution_reason"),
        F.create_map(F.when(F.col("p_partkey") % 4 == 0, "flag").otherwise("vendor:flag"), F.lit("1")).alias("extensions"),
    )
    return P.check_envelope(rows, "runloom:product", 2)


def snapshots(t: Tables) -> DataFrame:
    entry = F.struct("p_partkey", F.col("p_type").alias("entry_id"), F.when(F.col("p_size") % 3 == 0, "available").otherwise("restricted").alias("availability"), F.when(F.col("p_size") % 3 == 1, "LICENCE").alias("reason_code"))
    return t.part.groupBy(F.col("p_brand").alias("snapshot_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT p_brand AS subject_id, 'error' AS kind, 'duplicate-entry-id' AS code, CAST(pos AS VARCHAR) AS location FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY pos) AS nth FROM e) WHERE nth > 1
UNION ALL SELECT p_brand, 'error', 'access-reason-missing', p_type FROM e WHERE p_size % 3 = 2""")
def prd10_catalog_entries(t: Tables) -> DataFrame:
    return P.catalog_entries(snapshots(t))[1]


def reports(t: Tables) -> DataFrame:
    metric = F.struct(F.col("turn"), F.col("role").alias("metric_id"))
    c = t.conversations.groupBy(F.col("conv_id").alias("report_id")).agg(F.array_sort(F.collect_list(metric)).alias("metrics"), F.count("*").alias("n"))
    status = F.when(F.col("n") < 3, "pass").when(F.col("n") < 6, "warn").otherwise("fail")
    return c.select("report_id", "metrics", status.alias("status"), F.array(F.struct(F.lit("length").alias("code"))).alias("findings"))


@query("SELECT status, count(*) AS n_reports FROM (SELECT conv_id, CASE WHEN count(*) < 3 THEN 'pass' WHEN count(*) < 6 THEN 'warn' ELSE 'fail' END AS status FROM conversations GROUP BY conv_id) GROUP BY status")
def prd11_qc_by_status(t: Tables) -> DataFrame:
    return P.qc_tables(reports(t))["by_status"]


QC = """c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, length(text) AS n FROM conversations)"""


def full_reports(t: Tables) -> DataFrame:
    """A report a conversation: a metric a turn, named after the role, and a finding for every long one."""
    turn = F.struct("turn", "role", "text")
    nested = t.conversations.groupBy(F.col("conv_id").alias("report_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    metric = lambda x: F.struct(x["role"].alias("metric_id"), F.length(x["text"]).alias("value"))
    finding = lambda x: F.struct(F.lit("LONG").alias("finding_code"), F.length(x["text"]).alias("size"))
    return nested.select("report_id", F.lit("pass").alias("status"), F.transform("turns", metric).alias("metrics"), F.transform(F.filter("turns", lambda x: F.length(x["text"]) > 100), finding).alias("findings"))


@query(f"WITH {QC} SELECT conv_id AS report_id, pos, role AS metric_id, n AS value FROM c")
def prd11_qc_metrics(t: Tables) -> DataFrame:
    return P.qc_tables(full_reports(t))["metrics"].withColumn("pos", F.col("pos").cast("long")).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {QC} SELECT conv_id AS report_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos, 'LONG' AS finding_code, n AS size FROM c WHERE n > 100")
def prd11_qc_findings(t: Tables) -> DataFrame:
    return P.qc_tables(full_reports(t))["findings"].withColumn("pos", F.col("pos").cast("long")).withColumn("size", F.col("size").cast("long"))


@query(f"WITH {QC} SELECT CAST(conv_id AS VARCHAR) AS subject_id, 'error' AS kind, 'duplicate-metric-id' AS code, CAST(pos AS VARCHAR) AS location FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY pos) AS nth FROM c) WHERE nth > 1")
def prd11_qc_duplicates(t: Tables) -> DataFrame:
    return P.qc_tables(full_reports(t))["issues"]


def whole_products(t: Tables) -> dict[str, DataFrame]:
    """Tables of parts as products: suppliers are layers and ancestors, sizes axes of a geometry."""
    lines_ = t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list("l_suppkey")).alias("suppliers"))
    rows = t.part.join(lines_, "p_partkey")
    axes = F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.struct(F.concat(F.lit("x"), i.cast("string")).alias("axis_id"), F.lit("range").alias("role")))
    nested = rows.select(
        F.col("p_partkey").alias("product_id"), F.transform("suppliers", lambda k: F.struct(F.concat(F.lit("l"), k.cast("string")).alias("layer_id"), F.lit("band").alias("role"))).alias("layers"),
        F.array(F.struct(F.lit("g").alias("geometry_id"), F.lit("radar").alias("domain"), axes.alias("axes"))).alias("geometries"), F.transform("suppliers", lambda k: F.struct(F.lit("source").alias("role"), k.alias("artifact"))).alias("lineage"),
        F.transform("suppliers", lambda k: F.struct(k.alias("record_id"))).alias("acquisition_refs"), F.create_map(F.lit("brand"), F.struct(F.lit("known").alias("status"), F.col("p_brand").alias("value"))).alias("semantic_metadata"),
        F.create_map(F.lit("x:size"), F.col("p_size").cast("string"), F.lit("x:type"), F.col("p_type")).alias("extensions"),
    )
    return P.explode_products(nested)


SUPPLIED = "s AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY k) - 1 AS pos FROM s), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT product_id FROM s))"
CHILD_SQL = {
    "layers": "SELECT product_id, pos, 'l' || CAST(k AS VARCHAR) || ':band' AS said FROM r",
    "geometries": "SELECT p_partkey, 0, 'g:radar' FROM p",
    "axes": "SELECT p_partkey, unnest(range(p_size % 3 + 1)), 'g:x' || CAST(unnest(range(1, p_size % 3 + 2)) AS VARCHAR) || ':range' FROM p",
    "lineage": "SELECT product_id, pos, 'source:' || CAST(k AS VARCHAR) FROM r",
    "acquisition_refs": "SELECT product_id, pos, CAST(k AS VARCHAR) FROM r",
    "semantic_metadata": "SELECT p_partkey, NULL, 'brand:known:' || p_brand FROM p",
    "extensions": "SELECT p_partkey, NULL, unnest(['x:size:' || CAST(p_size AS VARCHAR), 'x:type:' || p_type]) FROM p",
}


@query(f"WITH {SUPPLIED} SELECT child, product_id, CAST(pos AS BIGINT) AS pos, said FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS child, * FROM ({q}) AS x(product_id, pos, said)" for c, q in CHILD_SQL.items()) + ")")
def prd1_child_tables(t: Tables) -> DataFrame:
    found, tables = None, whole_products(t)
    text = {
        "layers": ["layer_id", "role"], "geometries": ["geometry_id", "domain"], "axes": ["geometry_id", "axis_id", "role"], "lineage": ["role", "artifact"], "acquisition_refs": ["record_id"], "semantic_metadata": ["name", "value.status", "value.value"], "extensions": ["name", "value"],
    }
    for child, columns in text.items():
        pos = F.col("pos").cast("long") if "pos" in tables[child].columns else F.lit(None).cast("long")
        rows = tables[child].select(F.lit(child).alias("child"), "product_id", pos.alias("pos"), F.concat_ws(":", *[F.col(c).cast("string") for c in columns]).alias("said"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("SELECT event_id AS record_id, 'k' AS name, 'known' AS status, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS reason_code FROM events")
def prd12_acquisition_attributes(t: Tables) -> DataFrame:
    known = F.transform_values(F.from_json("props", "map<string,string>"), lambda _, v: F.struct(F.lit("known").alias("status"), v.alias("value"), F.lit(None).cast("string").alias("reason_code")))
    return P.acquisition_attributes(t.events.select(F.col("event_id").alias("record_id"), known.alias("attributes")))


@query("""SELECT event_id AS path, CASE event_id % 5 WHEN 1 THEN 'RECORD_JSON' WHEN 2 THEN 'RECORD_FIELDS' WHEN 3 THEN 'RECORD_TYPE' WHEN 4 THEN 'RECORD_SCHEMA' END AS reject_code FROM events WHERE event_id % 5 > 0""")
def src1_read_records(t: Tables) -> DataFrame:
    m = F.col("event_id") % 5
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(m == 1, F.concat(F.lit('{"schema_id":"s","k":'), k, F.lit(',"k":1}')))
        .when(m == 2, F.concat(F.lit('{"schema_id":"s","k":'), k, F.lit(',"x":1}')))
        .when(m == 3, F.lit('{"schema_id":"s","k":true}'))
        .when(m == 4, F.concat(F.lit('{"schema_id":"z","k":'), k, F.lit("}")))
        .otherwise(F.concat(F.lit('{"schema_id":"s","k":'), k, F.lit("}")))
    )
    schema = T.StructType([T.StructField("schema_id", T.StringType()), T.StructField("k", T.LongType())])
    return records.parse_records(t.events.select(F.col("event_id").alias("path"), text.alias("value")), schema, "s")[1].drop("reject_path")


NESTED = [
    ("%s", None, None),
    ("true", "RECORD_TYPE", "$.rows[0].n"),
    ("%s.5", "RECORD_TYPE", "$.rows[0].n"),
    ("\"%s\"", "RECORD_TYPE", "$.rows[0].n"),
    ("99999999999999999999", "RECORD_TYPE", "$.rows[0].n"),
    ("%s,\"other\":1", "RECORD_FIELDS", "$.rows[0].other"),
    ("null", None, None),
    ("%s},{\"n\":1", "RECORD_FIELDS", "$.rows[1].by"),
    ("%s},{\"by\":{\"k\":{\"x\":[1,2,null]},\"l\":{\"x\":[1,\"2\"]}},\"n\":1", "RECORD_TYPE", "$.rows[1].by.l.x[1]"),
    ("%s},{\"by\":{\"k\":{}},\"n\":1", "RECORD_FIELDS", "$.rows[1].by.k.x"),
    ("%s},[1],{\"n\":1", "RECORD_TYPE", "$.rows[1]"),
]


def nested_case(column: int) -> str:
    quoted = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    return f"CASE event_id % {len(NESTED)} " + " ".join(f"WHEN {i} THEN {quoted(case[column])}" for i, case in enumerate(NESTED)) + " END"


@query(f"""SELECT event_id AS path, {nested_case(1)} AS reject_code, {nested_case(2)} AS reject_path, CASE WHEN {nested_case(1)} IS NULL AND event_id % {len(NESTED)} = 0 THEN CAST(regexp_extract(props, '-?\\d+') AS BIGINT) END AS n FROM events""")
def src1_nested_types(t: Tables) -> DataFrame:
    """A record an event, whose rows hold maps of structs of arrays; by the event's number one of them isn't as asked."""
    k = F.get_json_object("props", "$.k")
    first = F.lit(None).cast("string")
    for i, (body, _, _) in reversed(list(enumerate(NESTED))):
        first = F.when(F.col("event_id") % len(NESTED) == i, F.concat(*[p for part in body.split("%s") for p in (k, F.lit(part))][1:])).otherwise(first)
    text = F.concat(F.lit('{"schema_id":"s","rows":[{"by":{"k":{"x":[1.5]}},"n":'), first, F.lit("}]}"))
    schema = T.StructType().add("schema_id", "string").add("rows", T.ArrayType(T.StructType().add("n", "long").add("by", T.MapType(T.StringType(), T.StructType().add("x", T.ArrayType(T.DoubleType()))))))
    good, refused = records.parse_records(t.events.select(F.col("event_id").alias("path"), text.alias("value")), schema, "s")
    none = F.lit(None).cast("string")
    return good.select("path", none.alias("reject_code"), none.alias("reject_path"), F.col("rows")[0]["n"].alias("n")).unionByName(refused.withColumn("n", F.lit(None).cast("long")))


@query("SELECT event_id AS config_id, sha256(props) AS sha256, CAST(strlen(props) AS BIGINT) AS size_bytes, props AS text, CAST(NULL AS VARCHAR) AS issue_code FROM events")
def src4_config_documents(t: Tables) -> DataFrame:
    return records.read_config_documents(t.events, "event_id", "props")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1")
def snk1_append_facts(t: Tables) -> DataFrame:
    new = t.orders.select("o_orderkey", "o_custkey")
    return records.append_facts(new, t.orders.where("o_custkey % 2 = 0"), ["o_orderkey"])[0]


INDEX = "SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS fingerprint, 'runs/' || CAST(o_orderkey AS VARCHAR) AS receipt, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS recipe_prefix FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0 AND o_orderkey % 7 <> 0"


def receipts(t: Tables) -> DataFrame:
    fp = F.when(F.col("o_custkey") % 3 == 0, "weak").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256))
    outputs = F.array(F.sha2("o_orderpriority", 256), F.when(F.col("o_orderkey") % 7 != 0, F.sha2("o_orderstatus", 256)))
    return t.orders.select(F.concat_ws("/", F.lit("runs"), "o_orderkey").alias("path"), fp.alias("fingerprint"), F.when(F.col("o_orderstatus") == "F", "auto").otherwise("disabled").alias("cache_policy"), outputs.alias("output_digests"))


@query(INDEX)
def snk3_reuse_index(t: Tables) -> DataFrame:
    return records.reuse_index(receipts(t))
