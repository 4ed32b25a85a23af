"""Settings tables (CFG): one sparse document per customer, old option rows per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import config as C
from runloom.plans.registry import Tables, query
from runloom.sources.shared import dealt

#: Leaves of each customer's document, in SQL that Spark and DuckDB read alike: (path, value, condition).
DAY = "CAST(date '2020-01-01' + CAST({n} AS INTEGER) AS {s})"
LEAVES = [
    ("schema_version", "CASE WHEN c_custkey % 50 = 0 THEN '2' ELSE '1' END", "true"),
    ("workflow.type", "'\"stack\"'", "c_custkey % 3 = 0"),
    ("workflow.pair.selection", "CASE WHEN c_custkey % 3 = 1 THEN '\"manual\"' ELSE '\"event\"' END", "c_custkey % 3 > 0 AND c_custkey % 41 > 0"),
    ("workflow.pair.reference_date", "'\"' || replace(" + DAY.format(n="c_custkey % 300", s="STRING") + ", '-', '') || '\"'", "c_custkey % 3 = 1"),
    ("workflow.pair.secondary_date", "'\"' || " + DAY.format(n="c_custkey % 300 + c_custkey % 20 - 3", s="STRING") + " || '\"'", "c_custkey % 3 = 1"),
    ("workflow.pair.event_date", "'\"' || " + DAY.format(n="c_custkey % 300", s="STRING") + " || '\"'", "c_custkey % 3 = 2"),
    ("workflow.stack.start_date", "'\"' || " + DAY.format(n="c_custkey % 300", s="STRING") + " || '\"'", "c_custkey % 3 = 0"),
    ("workflow.stack.end_date", "'\"' || " + DAY.format(n="c_custkey % 300 + c_custkey % 20 - 3", s="STRING") + " || '\"'", "c_custkey % 3 = 0 AND c_custkey % 37 > 0"),
    ("data.search.longitude", "CAST(c_custkey % 390 - 195 AS STRING)", "true"),
    ("data.search.latitude", "CAST(c_custkey % 91 AS STRING)", "true"),
    ("data.provider", "'\"cdse\"'", "c_custkey % 4 = 0"),
    ("mission.platform", "CASE WHEN c_custkey % 7 = 0 THEN '\"ALOS\"' ELSE '\"S1A\"' END", "c_custkey % 5 = 0"),
    ("resources.num_proc", "CASE WHEN c_custkey % 3 = 2 THEN '1' ELSE '0' END", "c_custkey % 2 = 0"),
    ("project.work_dir", "'\"w/../d' || CAST(c_custkey % 10 AS STRING) || '\"'", "c_custkey % 6 > 0"),
    ("data.paths.slc_dir", "'\"shared\"'", "c_custkey % 9 = 0"),
    ("data.paths.orbit_dir", "'\"shared\"'", "c_custkey % 27 = 0"),
    ("processing.isce2.pair.unwrap", "'false'", "c_custkey % 3 > 0 AND c_custkey % 8 = 1"),
    ("zz.unknown", "'1'", "c_custkey % 30 = 0"),
    ("outputs.stack_advice.enabled", "'true'", "c_custkey % 31 = 0"),
    ("outputs.figures.dpi", "CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE 'true' END", "c_custkey % 29 = 0"),
]
_ROWS = " UNION ALL ".join(f"SELECT c_custkey AS config_id, '{p}' AS path, {v} AS value_json FROM customer WHERE {w}" for p, v, w in LEAVES)
BASE_SQL = f"leaves AS MATERIALIZED ({_ROWS.replace('STRING', 'VARCHAR')})"
_NULL = "NULL"
_VALUES = ", ".join(
    f"('{p}', '{path}', '{k[0]}', {k[1] if k[1] is not None else _NULL}, {k[2] if k[2] is not None else _NULL}, {list(c or ())!r}, {_NULL if d is None else repr(d)}, {_NULL if o is None else repr(o)}, {str(path in C.NULLABLE).lower()})"
    for path, ps, k, c, d, o in C.FIELDS
    for p in ps
)
RULES = f"rules AS (SELECT * FROM (VALUES {_VALUES}) AS r(profile, path, rule, low, high, choices, default_json, default_origin, nullable))"
PROFILE = """w AS (SELECT config_id, max(value_json) FILTER (path = 'schema_version') AS v, coalesce(max(value_json) FILTER (path = 'workflow.type'), '"pair"') AS t, max(value_json) FILTER (path = 'workflow.pair.selection') AS s FROM leaves GROUP BY config_id),
profiles AS (SELECT config_id, CASE WHEN v = '1' AND t = '"stack"' THEN 'stack' WHEN v = '1' AND t = '"pair"' THEN replace(s, '"', '') END AS profile, CASE WHEN v <> '1' THEN 'CONFIG_VERSION' WHEN t = '"pair"' AND s IS NULL THEN 'CONFIG_REQUIRED' END AS issue_code,
  CASE WHEN v <> '1' THEN 'schema_version' WHEN t = '"pair"' AND s IS NULL THEN 'workflow.pair.selection' END AS issue_path FROM w)"""
OVERRIDES = """overrides AS (SELECT c_custkey AS config_id, 'outputs.figures.dpi' AS path, '150' AS value_json FROM customer WHERE c_custkey % 4 = 1
  UNION ALL SELECT c_custkey, 'data.provider', '"asf"' FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT c_custkey, 'workflow.type', '"pair"' FROM customer WHERE c_custkey % 33 = 0 UNION ALL SELECT c_custkey, 'outputs.figures.dpi', '151' FROM customer WHERE c_custkey % 100 = 1)"""
CANON = """canon AS (SELECT config_id, path, CASE WHEN ends_with(path, '_date') AND length(value_json) = 10 THEN substr(value_json, 1, 5) || '-' || substr(value_json, 6, 2) || '-' || substr(value_json, 8, 3) WHEN value_json = '"S1A"' THEN '"Sentinel-1A"' ELSE value_json END AS value_json FROM leaves)"""
FULL = f"""{BASE_SQL}, {RULES}, {PROFILE}, {CANON}, prov AS (SELECT config_id, value_json AS provider FROM canon WHERE path = 'data.provider'),
filled AS MATERIALIZED (SELECT p.config_id, p.profile, r.path, CASE WHEN c.value_json IS NULL AND r.path = 'data.catalog.timeout_seconds' THEN CASE WHEN provider = '"cdse"' THEN '90' ELSE '60' END ELSE coalesce(c.value_json, r.default_json) END AS value_json,
  CASE WHEN c.value_json IS NOT NULL THEN 'yaml' ELSE default_origin END AS origin, CASE WHEN c.value_json IS NULL AND r.path = 'data.catalog.timeout_seconds' THEN 'data.provider' ELSE '' END AS dependencies
  FROM profiles p JOIN rules r ON r.profile = p.profile LEFT JOIN canon c ON c.config_id = p.config_id AND c.path = r.path LEFT JOIN prov ON prov.config_id = p.config_id)"""
DIRS = ", ".join(f"('{p}', '{s}')" for p, s in C.DIRECTORIES.items())
DERIVED = f"""{FULL}, dirs AS (SELECT * FROM (VALUES {DIRS}) AS d(path, suffix)),
work AS (SELECT config_id, CASE WHEN value_json = '"."' THEN '/cfg' ELSE '/cfg/d' || CAST(config_id % 10 AS VARCHAR) END AS work FROM filled WHERE path = 'project.work_dir'),
width AS (SELECT config_id, value_json AS width FROM filled WHERE path = 'data.search.half_width_deg'),
resolved AS (SELECT f.config_id, f.profile, f.path, CASE WHEN f.path = 'project.work_dir' THEN '"' || work || '"' WHEN suffix IS NOT NULL AND value_json = 'null' THEN '"' || work || '/' || suffix || '"' WHEN suffix IS NOT NULL THEN '"/cfg/' || replace(value_json, '"', '') || '"'
  WHEN f.path = 'processing.roi.half_width_deg' AND value_json = 'null' THEN width ELSE value_json END AS value_json,
  CASE WHEN value_json = 'null' AND (suffix IS NOT NULL OR f.path = 'processing.roi.half_width_deg') THEN 'derived' ELSE origin END AS origin,
  CASE WHEN value_json = 'null' AND suffix IS NOT NULL THEN 'project.work_dir' WHEN value_json = 'null' AND f.path = 'processing.roi.half_width_deg' THEN 'data.search.half_width_deg' ELSE dependencies END AS dependencies
  FROM (SELECT * FROM filled WHERE value_json IS NOT NULL) f JOIN work ON work.config_id = f.config_id LEFT JOIN width ON width.config_id = f.config_id LEFT JOIN dirs d ON d.path = f.path)"""
DIRTY = """SELECT l.config_id, l.path, CASE WHEN r.rule = 'platform' AND value_json = '"ALOS"' THEN 'CONFIG_RANGE' WHEN r.rule = 'real' AND (CAST(value_json AS DOUBLE) < low OR CAST(value_json AS DOUBLE) > high) THEN 'CONFIG_RANGE'
  WHEN l.path = 'outputs.figures.dpi' AND value_json = 'true' THEN 'CONFIG_TYPE' WHEN l.path = 'outputs.figures.dpi' AND value_json = '0' THEN 'CONFIG_RANGE' END AS code FROM leaves l JOIN profiles p ON p.config_id = l.config_id JOIN rules r ON r.profile = p.profile AND r.path = l.path"""
CHECKED = f"""{BASE_SQL}, {RULES}, {PROFILE}, found AS (SELECT * FROM ({DIRTY}) WHERE code IS NOT NULL UNION ALL SELECT l.config_id, l.path, CASE WHEN l.path = 'zz.unknown' THEN 'CONFIG_UNKNOWN_KEY' ELSE 'CONFIG_CONFLICT' END
  FROM leaves l JOIN profiles p ON p.config_id = l.config_id AND p.profile IS NOT NULL WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.profile = p.profile AND r.path = l.path))"""


def leaves(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("runloom_customer")
    return t.spark.sql(_ROWS.replace("FROM customer", "FROM runloom_customer"))


def dealt_customers(t: Tables) -> DataFrame:
    """Keys of customers, dealt while they are still small; a file of few bytes would be widened by one task."""
    return dealt(t.customer.select("c_custkey"), "c_custkey")


def dealt_leaves(t: Tables) -> DataFrame:
    """The same leaves in one scan, dealt by document."""
    each = F.array(*[F.when(F.expr(w), F.struct(F.lit(p).alias("path"), F.expr(v).alias("value_json"))) for p, v, w in LEAVES])
    return dealt_customers(t).select(F.col("c_custkey").alias("config_id"), F.explode(each).alias("l")).where("l IS NOT NULL").select("config_id", "l.*")


def explained(t: Tables) -> DataFrame:
    base = dealt_customers(t).select(F.col("c_custkey").alias("config_id"), F.lit("/cfg").alias("base"))
    return C.explained(dealt_leaves(t), base, C.rules(t.spark))


def overrides(t: Tables) -> DataFrame:
    c, k = t.customer, F.col("c_custkey")
    row = lambda when, path, value: c.where(when).select(k.alias("config_id"), F.lit(path).alias("path"), F.lit(value).alias("value_json"))
    out = row(k % 4 == 1, "outputs.figures.dpi", "150").unionByName(row(k % 8 == 0, "data.provider", '"asf"'))
    return out.unionByName(row(k % 33 == 0, "workflow.type", '"pair"')).unionByName(row(k % 100 == 1, "outputs.figures.dpi", "151"))


def base(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("config_id"), F.lit("/cfg").alias("base"))


def full(t: Tables) -> DataFrame:
    rows = C.canonical_leaves(leaves(t)).withColumn("origin", F.lit("yaml"))
    return C.fill_defaults(rows, C.select_profile(leaves(t)), C.rules(t.spark))[0]


def resolved(t: Tables) -> DataFrame:
    return C.derive_fields(full(t), base(t))


@query("""SELECT event_id AS config_id, path, value_json FROM (SELECT event_id, 'schema_version' AS path, '1' AS value_json FROM events UNION ALL SELECT event_id, 'data.search.longitude', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'data.extra', NULL FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'project.name', '"' || event_type || '"' FROM events)""")
def cfg1_flatten_leaves(t: Tables) -> DataFrame:
    extra = F.when(F.col("event_id") % 2 == 0, ',"extra":1').otherwise("")
    text = F.concat(F.lit('{"schema_version":1,"project":{"name":"'), "event_type", F.lit('"},"data":{"search":{"longitude":'), F.get_json_object("props", "$.k"), F.lit("}"), extra, F.lit("}}"))
    return C.flatten_leaves(t.events.select(F.col("event_id").alias("config_id"), text.alias("text")))


@query(f"WITH {BASE_SQL}, {PROFILE} SELECT config_id, profile, issue_code, issue_path FROM profiles")
def cfg2_select_profile(t: Tables) -> DataFrame:
    return C.select_profile(leaves(t))


@query(f"WITH {CHECKED} SELECT CAST(config_id AS VARCHAR) AS subject_id, 'error' AS kind, code, path AS location FROM found")
def cfg3_check_leaves(t: Tables) -> DataFrame:
    return C.check_leaves(leaves(t), C.select_profile(leaves(t)), C.rules(t.spark))


@query(f"WITH {BASE_SQL}, {OVERRIDES} SELECT coalesce(l.config_id, o.config_id) AS config_id, coalesce(l.path, o.path) AS path, coalesce(o.value_json, l.value_json) AS value_json, CASE WHEN o.value_json IS NOT NULL THEN 'cli_override' ELSE 'yaml' END AS origin FROM leaves l FULL OUTER JOIN overrides o ON l.config_id = o.config_id AND l.path = o.path")
def cfg4_apply_overrides(t: Tables) -> DataFrame:
    return C.apply_overrides(leaves(t), overrides(t))


@query(f"""WITH {BASE_SQL}, {PROFILE}, {OVERRIDES} SELECT DISTINCT CAST(config_id AS VARCHAR) AS subject_id, 'error' AS kind, 'CONFIG_OVERRIDE' AS code, path AS location FROM (
SELECT config_id, path FROM overrides GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT config_id, path FROM overrides WHERE path = 'workflow.type' UNION ALL SELECT o.config_id, '' FROM overrides o JOIN profiles p ON p.config_id = o.config_id WHERE p.profile IS NULL)""")
def cfg4_check_overrides(t: Tables) -> DataFrame:
    return C.check_overrides(overrides(t), C.select_profile(leaves(t)), C.rules(t.spark))


@query(f"WITH {FULL} SELECT config_id, path, value_json, origin, dependencies FROM filled WHERE value_json IS NOT NULL")
def cfg5_fill_defaults(t: Tables) -> DataFrame:
    return full(t).select("config_id", "path", "value_json", "origin", F.array_join("dependencies", ",").alias("dependencies"))


#: The same as DERIVED in one pass: what other settings need of a document stands beside each of its rows.
@query(f"""WITH {BASE_SQL}, {RULES}, {PROFILE}, canon AS (SELECT config_id, path, CASE WHEN ends_with(path, '_date') AND length(value_json) = 10 THEN substr(value_json, 1, 5) || '-' || substr(value_json, 6, 2) || '-' || substr(value_json, 8, 3) WHEN value_json = '"S1A"' THEN '"Sentinel-1A"' ELSE value_json END AS value_json FROM leaves),
j AS (SELECT p.config_id, r.path, c.value_json AS given, r.default_json, r.default_origin FROM profiles p JOIN rules r ON r.profile = p.profile LEFT JOIN canon c ON c.config_id = p.config_id AND c.path = r.path),
s AS (SELECT *, max(given) FILTER (path = 'data.provider') OVER o AS provider, max(coalesce(given, default_json)) FILTER (path = 'data.search.half_width_deg') OVER o AS width,
  CASE max(coalesce(given, default_json)) FILTER (path = 'project.work_dir') OVER o WHEN '"."' THEN '/cfg' ELSE '/cfg/d' || CAST(config_id % 10 AS VARCHAR) END AS work FROM j WINDOW o AS (PARTITION BY config_id)),
f AS (SELECT *, given IS NULL AND path = 'data.catalog.timeout_seconds' AS timed, coalesce(given, CASE WHEN path <> 'data.catalog.timeout_seconds' THEN default_json WHEN provider = '"cdse"' THEN '90' ELSE '60' END) AS v, map([{", ".join(repr(p) for p in C.DIRECTORIES)}], [{", ".join(repr(x) for x in C.DIRECTORIES.values())}])[path] AS suffix FROM s)
SELECT config_id, path, CASE WHEN path = 'project.work_dir' THEN '"' || work || '"' WHEN suffix IS NOT NULL AND v = 'null' THEN '"' || work || '/' || suffix || '"' WHEN suffix IS NOT NULL THEN '"/cfg/' || replace(v, '"', '') || '"' WHEN path = 'processing.roi.half_width_deg' AND v = 'null' THEN width ELSE v END AS value_json,
  CASE WHEN v = 'null' AND (suffix IS NOT NULL OR path = 'processing.roi.half_width_deg') THEN 'derived' WHEN given IS NOT NULL THEN 'yaml' ELSE default_origin END AS origin,
  CASE WHEN v = 'null' AND suffix IS NOT NULL THEN 'project.work_dir' WHEN v = 'null' AND path = 'processing.roi.half_width_deg' THEN 'data.search.half_width_deg' WHEN timed THEN 'data.provider' ELSE '' END AS dependencies FROM f WHERE v IS NOT NULL""")
def cfg6_derive_fields(t: Tables) -> DataFrame:
    return resolved(t).select("config_id", "path", "value_json", "origin", F.array_join("dependencies", ",").alias("dependencies"))


@query(f"WITH {DERIVED} SELECT CAST(config_id AS VARCHAR) AS subject_id, 'error' AS kind, 'CONFIG_PATH' AS code, 'project.work_dir' AS location FROM resolved r WHERE path IN (SELECT path FROM dirs) GROUP BY config_id HAVING count(DISTINCT value_json) < count(*)")
def cfg7_check_collisions(t: Tables) -> DataFrame:
    return C.check_collisions(explained(t).where("NOT deferred"))


@query(f"""WITH {DERIVED}, x AS (SELECT config_id, max(profile) AS profile, max(value_json) FILTER (path = 'workflow.pair.reference_date') AS ref, max(value_json) FILTER (path = 'workflow.pair.secondary_date') AS sec, max(value_json) FILTER (path = 'workflow.stack.start_date') AS a, max(value_json) FILTER (path = 'workflow.stack.end_date') AS b,
  max(value_json) FILTER (path = 'resources.num_proc') AS n, max(value_json) FILTER (path = 'processing.isce2.pair.unwrap') AS u, abs(CAST(max(value_json) FILTER (path = 'data.search.longitude') AS DOUBLE)) + 0.2 > 180 OR abs(CAST(max(value_json) FILTER (path = 'data.search.latitude') AS DOUBLE)) + 0.2 > 90 AS o FROM resolved GROUP BY config_id)
SELECT CAST(config_id AS VARCHAR) AS subject_id, 'error' AS kind, code, location FROM (SELECT config_id, 'CONFIG_CONFLICT' AS code, 'workflow.pair.secondary_date' AS location FROM x WHERE ref >= sec UNION ALL SELECT config_id, 'CONFIG_CONFLICT', 'workflow.stack.end_date' FROM x WHERE a >= b
UNION ALL SELECT config_id, 'CONFIG_CONFLICT', 'resources.num_proc' FROM x WHERE profile <> 'stack' AND n <> '0' UNION ALL SELECT config_id, 'CONFIG_CONFLICT', 'outputs.pair.phase_products' FROM x WHERE profile <> 'stack' AND u = 'false'
UNION ALL SELECT config_id, 'CONFIG_RANGE', unnest(['data.search.half_width_deg', 'processing.roi.half_width_deg']) FROM x WHERE o)""")
def cfg8_check_cross_fields(t: Tables) -> DataFrame:
    return C.check_cross_fields(explained(t).where("NOT deferred"))


AUDIT = f"{DERIVED}, audit AS (SELECT DISTINCT r.config_id, r.path, CASE WHEN r.path = 'mission.platform' THEN 'platform_alias' WHEN ends_with(r.path, '_date') THEN 'date_iso' ELSE 'path_absolute_lexical' END AS rule FROM resolved r JOIN leaves l ON l.config_id = r.config_id AND l.path = r.path WHERE l.value_json <> r.value_json)"


@query(f"WITH {AUDIT} SELECT config_id, path, rule FROM audit")
def cfg9_audit_normalizations(t: Tables) -> DataFrame:
    return C.audit_normalizations(leaves(t), resolved(t))


@query(f"""WITH {AUDIT} SELECT r.config_id, r.path, r.origin, r.dependencies, coalesce(a.rule, '') AS rules FROM resolved r LEFT JOIN audit a ON a.config_id = r.config_id AND a.path = r.path
UNION ALL SELECT config_id, unnest({list(C.DEFERRED)!r}), 'deferred', '', '' FROM (SELECT DISTINCT config_id FROM resolved) UNION ALL SELECT DISTINCT config_id, 'event_bracketing', 'deferred', '', '' FROM resolved WHERE profile = 'event'""")
def cfg10_explain(t: Tables) -> DataFrame:
    return explained(t).select("config_id", "path", "origin", F.array_join("dependencies", ",").alias("dependencies"), F.coalesce("rule", F.lit("")).alias("rules"))


@query(f"WITH {CHECKED} SELECT CAST(config_id AS VARCHAR) AS subject_id, 'error' AS kind, code, path AS location, row_number() OVER (PARTITION BY config_id ORDER BY path, code) AS issue_rank, row_number() OVER (PARTITION BY config_id ORDER BY path, code) = 1 AS headline FROM found")
def cfg11_rank_issues(t: Tables) -> DataFrame:
    return C.rank_issues(C.check_leaves(leaves(t), C.select_profile(leaves(t)), C.rules(t.spark)))


OPTION_ROWS = [
    ("mode", "'stack'", "c_custkey % 3 = 0"),
    ("lon", "CAST(c_custkey % 200 AS STRING)", "true"),
    ("lat", "CAST(c_custkey % 50 AS STRING)", "c_custkey % 23 > 0"),
    ("reference_date", "'20200105'", "c_custkey % 3 = 1"),
    ("secondary_date", "CASE WHEN c_custkey % 5 = 0 THEN '20200230' ELSE '2020-02-01' END", "c_custkey % 3 = 1"),
    ("event_date", "'20200301'", "c_custkey % 3 = 2"),
    ("start_date", "'20200101'", "c_custkey % 3 = 0"),
    ("end_date", "'20200601'", "c_custkey % 3 = 0"),
    ("platform", "'S1B'", "c_custkey % 4 = 0"),
    ("data_source", "'copernicus'", "c_custkey % 4 = 1"),
    ("dlonlat", "'1'", "c_custkey % 6 = 1"),
    ("search_dlonlat", "'2'", "c_custkey % 30 = 1"),
    ("num_proc", "CAST(c_custkey % 2 AS STRING)", "c_custkey % 7 = 0"),
    ("step", "CASE WHEN c_custkey % 10 = 0 THEN 'clean' ELSE 'config' END", "c_custkey % 5 = 0"),
    ("rel_orbit", "CAST(c_custkey % 100 AS STRING)", "c_custkey % 2 = 0"),
]
_OPTS = " UNION ALL ".join(f"SELECT c_custkey AS command_id, {i} AS ord, '{o}' AS option, {v} AS value FROM customer WHERE {w}" for i, (o, v, w) in enumerate(OPTION_ROWS))
BAD = "c_custkey % 23 = 0 OR c_custkey % 200 > 180 OR (c_custkey % 3 = 1 AND c_custkey % 5 = 0) OR c_custkey % 30 = 1 OR (c_custkey % 7 = 0 AND c_custkey % 2 = 1 AND c_custkey % 3 <> 0) OR c_custkey % 10 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 100 = 0)"


def options(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("runloom_customer")
    return t.spark.sql(_OPTS.replace("FROM customer", "FROM runloom_customer"))


_LEAF_SQL = [
    ("schema_version", "'1'", "true"), ("mission.name", "'\"sentinel1\"'", "true"), ("processing.backend", "'\"isce2\"'", "true"), ("workflow.type", "CASE WHEN c_custkey % 3 = 0 THEN '\"stack\"' ELSE '\"pair\"' END", "true"),
    ("workflow.pair.selection", "CASE WHEN c_custkey % 3 = 1 THEN '\"manual\"' ELSE '\"event\"' END", "c_custkey % 3 > 0"), ("data.search.longitude", "CAST(CAST(c_custkey % 200 AS DOUBLE) AS VARCHAR)", "true"), ("data.search.latitude", "CAST(CAST(c_custkey % 50 AS DOUBLE) AS VARCHAR)", "true"),
    ("workflow.pair.reference_date", "'\"2020-01-05\"'", "c_custkey % 3 = 1"), ("workflow.pair.secondary_date", "'\"2020-02-01\"'", "c_custkey % 3 = 1"), ("workflow.pair.event_date", "'\"2020-03-01\"'", "c_custkey % 3 = 2"),
    ("workflow.stack.start_date", "'\"2020-01-01\"'", "c_custkey % 3 = 0"), ("workflow.stack.end_date", "'\"2020-06-01\"'", "c_custkey % 3 = 0"), ("mission.platform", "'\"Sentinel-1B\"'", "c_custkey % 4 = 0"), ("data.provider", "'\"cdse\"'", "c_custkey % 4 = 1"),
    ("data.search.half_width_deg", "'1.0'", "c_custkey % 6 = 1"), ("resources.num_proc", "CAST(c_custkey % 2 AS VARCHAR)", "c_custkey % 7 = 0"), ("workflow.stage", "'\"prepare\"'", "c_custkey % 5 = 0"), ("mission.relative_orbit", "CAST(c_custkey % 100 AS VARCHAR)", "c_custkey % 2 = 0"),
]


@query(" UNION ALL ".join(f"SELECT c_custkey AS config_id, '{p}' AS path, {v} AS value_json FROM customer WHERE ({w}) AND NOT ({BAD})" for p, v, w in _LEAF_SQL))
def cfg12_translate_options(t: Tables) -> DataFrame:
    return C.translate_options(options(t))[0]


_MAPS = " UNION ALL ".join(f"SELECT c_custkey AS command_id, 'mapping' AS section, '{o}' AS name, '{':'.join(C.OPTIONS[o])}' AS detail FROM customer WHERE {w}" for o, _, w in OPTION_ROWS)
_NOTES = " UNION ALL ".join(
    f"SELECT c_custkey, '{s}', '{n}', '{d}' FROM customer WHERE {w}"
    for s, n, d, w in [
        ("mapping", "event_date", "workflow.pair.selection:event_selection", "c_custkey % 3 = 2"), ("mapping", "reference_date+secondary_date", "workflow.pair.selection:manual_selection", "c_custkey % 3 = 1"),
        ("synthesized", "schema_version", "schema_identity", "true"), ("synthesized", "project.work_dir", "legacy_cwd", "true"), ("synthesized", "mission.name", "fixed_mission_identity", "true"), ("synthesized", "processing.backend", "fixed_backend_identity", "true"),
        ("synthesized", "workflow.type", "legacy_parser_default", "c_custkey % 3 > 0"), ("notice", "LEGACY_EVENT_BRACKETING", "warning", "c_custkey % 3 = 2"), ("notice", "LEGACY_DEPRECATED_DLONLAT", "warning", "c_custkey % 6 = 1"),
        ("notice", "LEGACY_UNIQUE_ORBIT_DEFERRED", "info", "c_custkey % 2 = 1"), ("notice", "LEGACY_PAIR_NUM_PROC_NEUTRAL", "info", "c_custkey % 7 = 0 AND c_custkey % 3 > 0"), ("notice", "LEGACY_DEFAULTS_APPLIED", "info", "true"),
    ]
)


@query(f"{_MAPS} UNION ALL {_NOTES}")
def cfg13_translation_audit(t: Tables) -> DataFrame:
    return C.translation_audit(options(t))


_TRANSLATED = " UNION ALL ".join(f"SELECT c_custkey AS config_id, '{p}' AS path, {v} AS value_json FROM customer WHERE ({w}) AND NOT ({BAD})" for p, v, w in _LEAF_SQL)
_BASES = ", ".join(f"('{p}', '{b}')" for b, ps in C.DEFAULT_BASES.items() for p in ps)


@query(f"""WITH leaves AS MATERIALIZED ({_TRANSLATED}), {RULES}, {PROFILE}, bases AS (SELECT * FROM (VALUES {_BASES}) AS b(path, basis)), dirs AS (SELECT * FROM (VALUES {DIRS}) AS d(path, suffix)),
j AS (SELECT p.config_id, r.path, l.value_json AS given, r.default_json, r.default_origin FROM profiles p JOIN rules r ON r.profile = p.profile LEFT JOIN leaves l ON l.config_id = p.config_id AND l.path = r.path),
s AS (SELECT *, max(given) FILTER (path = 'data.provider') OVER o AS provider, max(coalesce(given, default_json)) FILTER (path = 'data.search.half_width_deg') OVER o AS width FROM j WINDOW o AS (PARTITION BY config_id))
SELECT config_id AS command_id, s.path, CASE WHEN s.path = 'data.catalog.timeout_seconds' THEN CASE WHEN provider = '"cdse"' THEN '90' ELSE '60' END WHEN suffix IS NOT NULL THEN '"/cwd/' || (config_id % 4) || '/' || suffix || '"' WHEN s.path = 'processing.roi.half_width_deg' THEN width ELSE default_json END AS value_json,
  coalesce(basis, CASE WHEN suffix IS NOT NULL THEN 'derived' ELSE default_origin END) AS basis, CASE WHEN s.path = 'data.catalog.timeout_seconds' THEN 'data.provider' WHEN suffix IS NOT NULL THEN 'project.work_dir' WHEN s.path = 'processing.roi.half_width_deg' THEN 'data.search.half_width_deg' ELSE '' END AS dependencies
FROM s LEFT JOIN bases b ON b.path = s.path LEFT JOIN dirs d ON d.path = s.path WHERE given IS NULL AND s.path <> 'project.work_dir' AND (default_json IS NOT NULL OR s.path = 'data.catalog.timeout_seconds')
UNION ALL SELECT c_custkey, 'workflow.type', '"pair"', 'legacy_parser_default', '' FROM customer WHERE c_custkey % 3 > 0 AND NOT ({BAD})""")
def cfg13_translation_defaults(t: Tables) -> DataFrame:
    folders = t.customer.select(F.col("c_custkey").alias("command_id"), F.concat(F.lit("/cwd/"), F.col("c_custkey") % 4).alias("folder"))
    return C.translation_defaults(options(t), folders).withColumn("dependencies", F.array_join("dependencies", ","))


@query("""WITH d AS (SELECT event_id, user_id, event_id % 9 AS line, CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra_forbidden' WHEN 2 THEN 'literal_error' WHEN 3 THEN 'too_long' WHEN 4 THEN 'value_error' WHEN 5 THEN 'int_type' ELSE 'CONFIG_PATH' END AS kind FROM events),
c AS (SELECT user_id, event_id, line, CASE kind WHEN 'missing' THEN 'CONFIG_REQUIRED' WHEN 'extra_forbidden' THEN 'CONFIG_UNKNOWN_KEY' WHEN 'literal_error' THEN 'CONFIG_UNSUPPORTED' WHEN 'too_long' THEN 'CONFIG_RANGE' WHEN 'value_error' THEN 'CONFIG_RANGE' WHEN 'int_type' THEN 'CONFIG_TYPE' ELSE kind END AS code FROM d)
SELECT CAST(user_id AS VARCHAR) AS subject_id, code, CAST(event_id AS VARCHAR) AS location, line, row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_id AS VARCHAR), code, line) AS issue_rank FROM c""")
def cfg11_diagnostic_issues(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("missing", "extra_forbidden", "literal_error", "too_long", "value_error", "int_type", "CONFIG_PATH")))
    i = F.col("event_id")
    raw = t.events.select("user_id", F.element_at(kinds, (i % 7 + 1).cast("int")).alias("kind"), i.cast("string").alias("path"), (i % 9).alias("line"))
    return C.rank_issues(C.diagnostic_issues(raw, "user_id")).select("subject_id", "code", "location", "line", "issue_rank")
