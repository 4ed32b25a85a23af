"""Semantic material: what may change a digest and what may not, weak and broken records, and the order of reasons."""

from __future__ import annotations

import copy
import hashlib
import json
import os

import pytest

from runloom.functions import material as M

HEX = hashlib.sha256(b"x").hexdigest()
REF = "struct<record_id:string,schema_id:string,schema_version:int,semantic_digest:string,manifest_digest:string,locator:string>"
SEM = "struct<status:string,value:{},reason_code:string,evidence_refs:array<" + REF + ">>"
PRODUCT = (
    "product_id string, product_kind string, profile_id string, profile_version int,"
    "assets array<struct<asset_id:string,asset_kind:string,location:string,size_bytes:bigint>>,"
    f"acquisition_refs array<{REF}>, semantic_metadata map<string,{SEM.format('string')}>, lineage array<struct<role:string,artifact:{REF}>>,"
    f"geometries array<struct<geometry_id:string,reference:{SEM.format(REF)}>>, layers array<struct<layer_id:string,source_ref:{REF}>>, extensions map<string,string>, reason string"
)


def ref(name, digest=None, locator="here"):
    return {"record_id": name, "schema_id": "s", "schema_version": 1, "semantic_digest": digest, "manifest_digest": HEX, "locator": locator}


def sem(value, *evidence):
    return {"status": "known", "value": value, "reason_code": None, "evidence_refs": list(evidence)}


BASE = {
    "product_id": "p", "product_kind": "k", "profile_id": "f", "profile_version": 1, "assets": [{"asset_id": "a", "asset_kind": "file", "location": "/x", "size_bytes": 3}],
    "acquisition_refs": [ref("r1", HEX)], "semantic_metadata": {"m": sem('{"b": 1, "a": [2, "é"]}')}, "lineage": [{"role": "in", "artifact": ref("r2")}],
    "geometries": [{"geometry_id": "g", "reference": sem(ref("r3"), ref("r1", HEX), ref("r4"))}], "layers": [{"layer_id": "l", "source_ref": None}], "extensions": {"x:y": "[1,2]"}, "reason": "clash",
}
DIGESTS = [(r, hashlib.sha256(r.encode()).hexdigest()) for r in ("r2", "r3", "r4")]


def content(spark, *changes, digests=DIGESTS, identities=None):
    """Digests and reasons of copies of BASE; a change is a function of the copy."""
    rows = []
    for i, change in enumerate(changes):
        row = copy.deepcopy(BASE)
        change(row)
        rows.append(row | {"product_id": str(i)})
    given = [(str(i), a["asset_id"], HEX) for i, r in enumerate(rows) for a in r["assets"] or []] if identities is None else identities
    out = M.product_content(spark.createDataFrame(rows, PRODUCT), "product_id", spark.createDataFrame(digests, "record_id string, semantic_digest string"), spark.createDataFrame(given, "product_id string, asset_id string, content_identity string"))
    return [(r.content_digest, r.reason) for r in out.orderBy(out.product_id.cast("int")).collect()]


def set_at(path, value):
    def change(row):
        *way, last = path
        for p in way:
            row = row[p]
        row[last] = value

    return change


def test_where_it_lies_does_not_count_and_what_it_says_does(spark):
    same = [
        lambda r: None, set_at(["assets", 0, "location"], "/elsewhere"), set_at(["assets", 0, "size_bytes"], 99), set_at(["acquisition_refs", 0, "locator"], "moved"), set_at(["acquisition_refs", 0, "record_id"], "other"),
        set_at(["lineage", 0, "artifact"], ref("other", DIGESTS[0][1])), set_at(["semantic_metadata", "m", "value"], '{"a":[2,"\\u00e9"],"b":1}'), set_at(["extensions", "x:y"], "[ 1,\n2 ]"), set_at(["reason"], "other"),
    ]
    other = [
        set_at(["product_kind"], "k2"), set_at(["assets", 0, "asset_kind"], "directory"), set_at(["acquisition_refs"], [ref("r1", HEX)] * 2), set_at(["geometries", 0, "reference", "evidence_refs"], [ref("r4"), ref("r1", HEX)]),
        set_at(["lineage", 0, "role"], "from"), set_at(["semantic_metadata", "m", "value"], '{"a":["é",2],"b":1}'), set_at(["layers", 0, "source_ref"], ref("r2")), set_at(["layers"], []), set_at(["semantic_metadata", "m", "status"], "unknown"),
    ]
    got = content(spark, *same, *other)
    assert {reason for _, reason in got} == {None}
    assert len({d for d, _ in got[: len(same)]}) == 1
    assert len({d for d, _ in got}) == 1 + len(other)


def test_material_text(spark):
    out = M.material(spark.createDataFrame([BASE], PRODUCT), "product", "product_id", spark.createDataFrame(DIGESTS, "record_id string, semantic_digest string"), spark.createDataFrame([("p", "a", "id-a")], "product_id string, asset_id string, content_identity string")).first()
    d = dict(DIGESTS)
    want = {
        "schema_id": M.MATERIAL_SCHEMA, "schema_version": 1, "extensions": {"x:y": [1, 2]},
        "product": {
            "product_kind": "k", "profile_id": "f", "profile_version": 1, "acquisition_semantic_digests": [HEX], "assets": [{"asset_id": "a", "asset_kind": "file", "content_identity": "id-a"}],
            "semantic_metadata": {"m": {"status": "known", "value": {"b": 1, "a": [2, "é"]}, "reason_code": None, "evidence_semantic_digests": []}}, "lineage": [{"role": "in", "artifact_semantic_digest": d["r2"]}],
            "geometries": [{"geometry_id": "g", "reference": {"status": "known", "value": d["r3"], "reason_code": None, "evidence_semantic_digests": [HEX, d["r4"]]}}], "layers": [{"layer_id": "l", "source_semantic_digest": None}],
        },
    }
    assert out.material == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out.assets == '{"a":"id-a"}'


def test_weak_and_broken_records_have_no_digest(spark):
    got = content(
        spark, set_at(["geometries", 0, "reference", "evidence_refs"], [ref("unknown")]), set_at(["lineage", 0, "artifact"], ref(None)), set_at(["semantic_metadata", "m", "value"], "{broken"), set_at(["extensions", "x:y"], '{"a":1,"a":2}'),
        set_at(["semantic_metadata", "m", "value"], None), set_at(["assets"], []), set_at(["assets"], None), set_at(["layers"], None),
    )
    assert [r for _, r in got] == ["REFERENCE_WEAK", "REFERENCE_WEAK", "MATERIAL_JSON", "MATERIAL_JSON", None, None, None, None]
    assert all((d is None) == (r is not None) for d, r in got)
    keep = lambda r: None
    for given, want in ([], "ASSET_SET"), ([("0", "a", None)], "ASSET_WEAK"), ([("0", "a", "")], "ASSET_WEAK"), ([("0", "a", HEX), ("0", "b", HEX)], "ASSET_SET"), ([("0", "a", HEX), ("9", "b", HEX)], None):
        assert [r for _, r in content(spark, keep, identities=given)] == [want]
    assert [r for _, r in content(spark, keep, digests=[])] == ["REFERENCE_WEAK"]
    assert content(spark) == []


QUALITY = (f"record_id string, schema_id string, schema_version int, status string, method_id string, method_version string, input_refs array<{REF}>, metrics array<struct<metric_id:string,value:{SEM.format('struct<value:double,source_ref:' + REF + '>')},details:string>>, findings array<struct<finding_code:string,details:string>>, extensions map<string,string>")


@pytest.fixture
def identify(spark):
    def run(producers, assets=None, valid=True, products=("p",)):
        quality = {"record_id": "q", "schema_id": "s", "schema_version": 1, "status": "pass", "method_id": "m", "method_version": "1", "input_refs": [ref("i", HEX)], "metrics": [{"metric_id": "x", "value": sem({"value": 1.5, "source_ref": ref("r2")}), "details": "{}"}], "findings": [], "extensions": {}}
        p = spark.createDataFrame([BASE | {"product_id": i} for i in products], PRODUCT).selectExpr("product_id AS record_id", "'s' AS schema_id", "1 AS schema_version", "*", f"{str(valid).lower()} AS structure_valid")
        made = spark.createDataFrame(producers, "record_type string, record_id string, recipe string, port string, inputs array<struct<port:string,semantic_digests:array<string>>>")
        given = spark.createDataFrame([(i, "a", HEX) for i in products] if assets is None else assets, "record_id string, asset_id string, content_identity string")
        out = M.artifact_identity({"product": p, "quality": spark.createDataFrame([quality], QUALITY)}, made, spark.createDataFrame(DIGESTS, "record_id string, semantic_digest string"), given)
        return {(r.record_type, r.record_id): (r.identity and r.identity.value, r.identity and list(r.identity.reasons), r.refused) for r in out.collect()}

    return run


def test_record_types_and_the_order_of_reasons(identify):
    good = [("product", "p", HEX, "out", []), ("quality", "q", HEX, "out", [("in", [HEX])])]
    got = identify(good)
    assert all(v and len(v) == 64 and r == [] and x is None for v, r, x in got.values())
    for change in (("product", "p", HEX, "other", []), ("product", "p", "0" * 64, "out", []), ("product", "p", HEX, "out", [("in", [HEX])])):
        assert identify([change])["product", "p"][0] not in (None, got["product", "p"][0])
    assert identify([("product", "p", "weak", "out", None)])["product", "p"] == (None, ["RESULT_RECIPE_WEAK"], None)
    assert identify([("product", "p", HEX, "out", None)])["product", "p"] == (None, ["RESULT_INPUT_IDENTITY_WEAK"], None)
    assert identify(good, assets=[("p", "a", "weak")])["product", "p"] == (None, ["RESULT_CONTENT_IDENTITY_WEAK"], None)
    assert identify(good, assets=[("p", "b", HEX)])["product", "p"][2] == "RESULT_ASSETS"
    assert identify(good, assets=[("p", "a", HEX), ("q", "a", HEX)])["quality", "q"][2] == "RESULT_ASSETS"
    assert identify(good, valid=False)["product", "p"][2] == "RESULT_PRODUCT_STRUCTURE"
    assert identify([("product", "p", "weak", " ", None)])["product", "p"] == (None, None, "RESULT_OUTPUT_PORT")
    assert identify([])["quality", "q"][2] == "RESULT_OUTPUT_PORT"


def test_references_travel_as_id_and_digest(spark, tmp_path):
    import contextlib
    import io

    none, bare = "CAST(array() AS array<struct<record_id:string,semantic_digest:string>>)", "named_struct('record_id', 'r', 'semantic_digest', sha2('r', 256))"
    ref = "named_struct('record_id', 'r', 'semantic_digest', sha2('r', 256), 'manifest_digest', sha2('m', 256), 'locator', 'l')"
    spark.sql(f"""SELECT id AS record_id, 's' AS schema_id, 1 AS schema_version, {ref} AS source_ref, 'm' AS mission,
        map('a', named_struct('status', 'known', 'value', '1', 'evidence_refs', {none})) AS attributes, array({bare}) AS evidence_refs, map('x:y', '1') AS extensions FROM range(2)""").write.parquet(f"{tmp_path}/r")
    made = spark.sql("SELECT 'acquisition' AS record_type, id AS record_id, sha2('x', 256) AS recipe, 'out' AS port, CAST(array() AS array<struct<port:string,semantic_digests:array<string>>>) AS inputs FROM range(2)")
    digests = spark.sql("SELECT 'r' AS record_id, sha2('r', 256) AS semantic_digest")
    out = M.artifact_identity({"acquisition": spark.read.parquet(f"{tmp_path}/r")}, made, digests)
    assert [r.identity.reusable for r in out.collect()] == [True, True]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain("formatted")
    assert "source_ref:struct<record_id" in plan.getvalue() and "locator" not in plan.getvalue()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["dig8_content_material", "dig9_product_identity", "dig9_acquisition_identity"])
def test_records_are_dealt_before_they_are_widened(spark, name):
    """What is shuffled are numbers, names and digests as bytes, never a record or a part of one."""
    from runloom.plans import all_queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kinds = [[f.dataType().simpleString() for f in exchanged(x)] for x in nodes(plan) if x.nodeName() == "Exchange"]
    assert kinds and not [k for k in kinds if any("<" in x for x in k)]
    assert ["bigint", "string", "binary", "string"] in kinds


def nodes(plan):
    found = plan.children()
    return [plan, *[x for i in range(found.size()) for x in nodes(found.apply(i))]]


def exchanged(node):
    out = node.output()
    return [out.apply(i) for i in range(out.size())]


def test_digests_that_are_no_hexadecimal_travel_too(spark):
    keep = lambda r: None
    odd = [("r2", "plain"), ("r3", HEX.upper()), ("r4", "é" * 31)]
    assert [r for _, r in content(spark, keep, digests=odd)] == [None]
    given = spark.createDataFrame([("p", "a", "id-a")], "product_id string, asset_id string, content_identity string")
    text = M.material(spark.createDataFrame([BASE], PRODUCT), "product", "product_id", spark.createDataFrame(odd, "record_id string, semantic_digest string"), given).first().material
    said = json.loads(text)["product"]
    assert (said["lineage"][0]["artifact_semantic_digest"], said["geometries"][0]["reference"]["value"], said["geometries"][0]["reference"]["evidence_semantic_digests"]) == ("plain", HEX.upper(), [HEX, "é" * 31])


def test_text_is_that_of_a_variant(spark):
    """Keys at every depth in the order of UTF-16, leaves of any type."""
    names = ["b", "", "\U0001f600", "a"]
    leaf = "named_struct('z', -9999.5D, 'y', named_struct('q', 1.50BD, 'b', array(date'2020-01-02', null)), 'x', CAST('NaN' AS DOUBLE), 'w', CAST(NULL AS string), 'v', 1e20D, 'u', X'01')"
    row = spark.sql(f"""SELECT 'p' AS product_id, 'k' AS product_kind, 'f' AS profile_id, 1 AS profile_version, array(named_struct('asset_kind', 'file', 'asset_id', ''), named_struct('asset_kind', 'file', 'asset_id', '\U0001f600')) AS assets,
        CAST(array() AS array<{REF}>) AS acquisition_refs, map({", ".join(f"'{n}', named_struct('value', '{i}', 'status', 'known')" for i, n in enumerate(names))}) AS semantic_metadata, CAST(NULL AS array<struct<role:string,artifact:{REF}>>) AS lineage,
        array({leaf}, NULL) AS geometries, array(map('k', 2, 'j', NULL)) AS layers, map('b', '1', 'a', NULL) AS extensions""")
    given = spark.createDataFrame([("p", "", "i"), ("p", "\U0001f600", "j")], "product_id string, asset_id string, content_identity string")
    got = M.material(row, "product", "product_id", None, given).first()
    v = spark.sql(f"SELECT to_json(to_variant_object(named_struct('geometries', array({leaf}, NULL), 'layers', array(map('k', 2, 'j', NULL))))) AS v").first().v
    said = json.loads(got.material)["product"]
    assert v[1:-1].split(',"layers":')[0] in got.material and '"layers":[{"j":null,"k":2}]' in got.material and said["geometries"][1] is None
    assert list(said["semantic_metadata"]) == ["a", "b", "\U0001f600", ""] and list(json.loads(got.material)["extensions"]) == ["a", "b"]
    assert got.assets == '{"\U0001f600":"j","":"i"}'


def test_ids_are_texts_or_numbers(spark):
    def run(*kinds):
        rows = spark.createDataFrame([BASE | {"product_id": "7"}], PRODUCT).selectExpr(f"CAST(product_id AS {kinds[0]}) AS record_id", "'s' AS schema_id", "1 AS schema_version", "*")
        made = spark.sql(f"SELECT 'product' AS record_type, CAST('7' AS {kinds[1]}) AS record_id, sha2('x', 256) AS recipe, 'out' AS port, CAST(array() AS array<struct<port:string,semantic_digests:array<string>>>) AS inputs")
        given = spark.sql(f"SELECT CAST('7' AS {kinds[2]}) AS record_id, 'a' AS asset_id, '{HEX}' AS content_identity")
        return M.artifact_identity({"product": rows}, made, spark.createDataFrame(DIGESTS, "record_id string, semantic_digest string"), given).first()

    numbers, texts, mixed = run("bigint", "bigint", "bigint"), run("string", "string", "string"), run("int", "string", "bigint")
    assert numbers == texts == mixed and numbers.record_id == "7" and numbers.identity.reusable
