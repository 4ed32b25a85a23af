"""What a record says, without where it lies: the semantic material that content and result digests are taken over.

A record's nested columns are rewritten by their schema. A reference (a struct with ``record_id`` and
``semantic_digest``) becomes the digest it stands for, at whatever depth; fields that hold references are renamed
after what they then hold; columns of opaque JSON become values; everything else is kept. Objects have their keys in
the order of a VARIANT's, so the text is canonical: it is that of one VARIANT, but only leaves whose text needs it are made one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.digests import PREFIX, canonical, domain_digest
from runloom.functions.exprs import is_digest, with_fingerprint

MATERIAL_SCHEMA, MATERIAL_VERSION = f"{PREFIX}:product-semantic-material", 1
CONTENT_DOMAIN, ARTIFACT_DOMAIN = f"{PREFIX}.product.content.v1", f"{PREFIX}.artifact.v1"

#: Fields of the record types that are part of what they say.
FIELDS = {
    "product": ["product_kind", "profile_id", "profile_version", "acquisition_refs", "semantic_metadata", "lineage", "geometries", "layers", "extensions"],
    "catalog": ["provider", "query_schema_id", "query_schema_version", "selectors", "entries", "extensions"],
    "acquisition": ["source_ref", "mission", "attributes", "evidence_refs", "extensions"],
    "quality": ["status", "method_id", "method_version", "input_refs", "metrics", "findings", "extensions"],
}
#: Where strings are opaque JSON: names of fields, those of maps and arrays in between left out.
JSON = {
    "product": {"semantic_metadata.value", "geometries.grid_definition.value.parameters", "extensions"},
    "catalog": {"selectors", "entries.attributes", "extensions"},
    "acquisition": {"attributes.value", "extensions"},
    "quality": {"metrics.value.value", "metrics.details", "findings.details", "extensions"},
}
#: Fields that stand under another name.
NAMES = {"catalog": {"entries.access.authentication_required": "access_required"}}

Hit = Callable[[T.DataType, str], bool]


def is_reference(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and {"record_id", "semantic_digest"} <= set(t.fieldNames())


def _is_reference_at(t: T.DataType, path: str) -> bool:
    return is_reference(t)


def _renamed(name: str, t: T.DataType) -> str:
    """The name of a field once its references are digests."""
    if is_reference(t):
        return name if name == "value" else f"{name.removesuffix('_ref')}_semantic_digest"
    if isinstance(t, T.ArrayType) and is_reference(t.elementType):
        return f"{name.removesuffix('_refs')}_semantic_digests"
    return name


def _below(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def _inner(t: T.DataType) -> T.DataType | None:
    return t.elementType if isinstance(t, T.ArrayType) else t.valueType if isinstance(t, T.MapType) else None


def _holds(t: T.DataType, path: str, at: Hit) -> bool:
    """Whether a place for which ``at`` is true lies in a type."""
    if at(t, path):
        return True
    if isinstance(t, T.StructType):
        return any(_holds(f.dataType, _below(path, f.name), at) for f in t)
    return (inner := _inner(t)) is not None and _holds(inner, path, at)


def _exists(c: Column, t: T.DataType, path: str, at: Hit, test: Callable[[Column], Column]) -> Column:
    """Whether ``test`` is true of any value at the places ``at`` in ``c``."""
    if at(t, path):
        return F.coalesce(test(c), F.lit(False))
    if isinstance(t, T.StructType):
        parts = [_exists(c[f.name], f.dataType, _below(path, f.name), at, test) for f in t if _holds(f.dataType, _below(path, f.name), at)]
        return reduce(lambda a, b: a | b, parts, F.lit(False)) if len(parts) > 1 else parts[0] if parts else F.lit(False)
    if (inner := _inner(t)) is None or not _holds(inner, path, at):
        return F.lit(False)
    return F.coalesce(F.exists(c if isinstance(t, T.ArrayType) else F.map_values(c), lambda x: _exists(x, inner, path, at, test)), F.lit(False))


def _places(t: T.DataType) -> list[tuple[str | None, ...]]:
    """The ways to all references in a type: names of fields, and none for the elements of an array or the values of a map."""
    if is_reference(t):
        return [()]
    if isinstance(t, T.StructType):
        return [(f.name, *way) for f in t for way in _places(f.dataType)]
    return [] if (inner := _inner(t)) is None else [(None, *way) for way in _places(inner)]


def _without_digest(c: Column, t: T.DataType, way: tuple[str | None, ...]) -> Column:
    """Record ids of the references at the end of a way in ``c`` that carry no digest, null for others: one, or an array where there may be many."""
    if not way:
        return F.when(F.coalesce(c["semantic_digest"], F.lit("")) == "", c["record_id"])
    if way[0] is not None:
        return _without_digest(c[way[0]], t[way[0]].dataType, way[1:])
    elements, inner = c if isinstance(t, T.ArrayType) else F.map_values(c), _inner(t)
    if None not in way[1:]:
        return F.transform(elements, lambda x: _without_digest(x, inner, way[1:]))
    return F.flatten(F.transform(elements, lambda x: F.coalesce(_without_digest(x, inner, way[1:]), F.array().cast("array<string>"))))


def _missing(c: Column, t: T.DataType) -> Column:
    """Record ids of all references in ``c`` that carry no digest, each once, and null among them."""
    found, none = [(_without_digest(c, t, way), None in way) for way in _places(t)], F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(*[x for x, many in found if not many]).cast("array<string>"), *[F.coalesce(x, none) for x, many in found if many]))


def _slim(c: Column, t: T.DataType) -> Column:
    """``c`` with references cut down to their id and digest, which is all that is looked at."""
    if not _holds(t, "", lambda kind, _: is_reference(kind) and len(kind) > 2):
        return c
    if is_reference(t):
        return F.when(c.isNotNull(), F.struct(c["record_id"].alias("record_id"), c["semantic_digest"].alias("semantic_digest")))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_slim(c[f.name], f.dataType).alias(f.name) for f in t]))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _slim(x, t.elementType))
    return F.transform_values(c, lambda _, x: _slim(x, t.valueType))


def _place(name: str) -> bytes:
    """Where a name stands among the keys of a VARIANT, which are in the order of UTF-16."""
    return name.encode("utf-16-be")


def _in_order(t: T.DataType) -> bool:
    """Whether ``to_json`` writes values of a type as it writes a VARIANT of them."""
    if isinstance(t, T.StructType):
        return len(t) > 0 and t.fieldNames() == sorted(t.fieldNames(), key=_place) and all(_in_order(f.dataType) for f in t)
    return _in_order(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _by_key(m: Column) -> Column:
    """A map with its entries in the order of a VARIANT's keys."""
    place = lambda e: F.encode(e["key"], "UTF-16BE")
    entries = F.array_sort(F.map_entries(m), lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0))
    return F.when(F.size(m) < 2, m).otherwise(F.map_from_entries(entries))


def _object(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[n].alias(n) for n in sorted(fields, key=_place)])


def _rewritten(c: Column, t: T.DataType, path: str, kind: str, digest: Callable[[Column], Column]) -> Column:
    """What ``c`` says, as a value whose JSON is canonical."""
    if is_reference(t):
        return digest(c)
    if path in JSON[kind] and isinstance(t, T.StringType):
        return F.try_parse_json(c)
    if _in_order(t) and not _holds(t, path, lambda kind_, at: is_reference(kind_) or at in JSON[kind] or at in NAMES.get(kind, {})):
        return c
    if isinstance(t, T.StructType):
        if not len(t):
            return F.to_variant_object(c)
        fields = {}
        for f in t:
            below = _below(path, f.name)
            fields[NAMES.get(kind, {}).get(below, _renamed(f.name, f.dataType))] = _rewritten(c[f.name], f.dataType, below, kind, digest)
        return F.when(c.isNotNull(), _object(fields))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _rewritten(x, t.elementType, path, kind, digest))
    if isinstance(t, T.MapType):
        return _by_key(F.transform_values(c, lambda _, x: _rewritten(x, t.valueType, path, kind, digest)))
    return c if isinstance(t, T.VariantType) else c.cast("variant")


def material(records: DataFrame, kind: str, key: str, digests: DataFrame | None = None, asset_identities: DataFrame | None = None, strict: bool = False, also: list[str] | None = None) -> DataFrame:
    """``(key, material, assets, reason)`` of records of one type (a key of :data:`FIELDS`), and their columns ``also``.

    ``material`` is canonical JSON, null with a ``reason``: ASSET_SET (identities are not of exactly the record's
    assets), ASSET_WEAK (one has none), REFERENCE_WEAK (a reference without a digest) or MATERIAL_JSON (opaque text
    that isn't JSON); the first that holds. ``digests`` (record_id, semantic_digest) serves references that carry no
    digest of their own, ``asset_identities`` (key, asset_id, content_identity) the assets of products, whose content
    it stands for; ``assets`` is the JSON of that map. With ``strict`` digests and identities must be SHA-256 in hex.

    Location, size, media type, integrity and manifest of assets, producer, provenance and ids of the record itself
    aren't looked at. Missing columns are an error. Ids are looked up once per record and id; no record is held beside
    another. A record is shuffled once, by its key, its references cut down to id and digest, and not at all if records were
    dealt by their key before they were widened; then only ids and digests, these as bytes, travel.
    """
    ok = (lambda d: F.coalesce(is_digest(d), F.lit(False))) if strict else (lambda d: F.coalesce(d != "", F.lit(False)))
    fields = FIELDS[kind]
    also = also or []
    kinds = {f.name: f.dataType for f in records.select(*fields).schema}
    own = [F.col(key).alias("of"), *also, F.struct(*[_slim(F.col(f), kinds[f]).alias(f) for f in fields]).alias("record"), *([F.transform("assets", lambda a: F.struct(a["asset_id"].alias("asset_id"), a["asset_kind"].alias("asset_kind"))).alias("own_assets")] if kind == "product" else [])]
    rows = records.select(*own)
    t = rows.schema["record"].dataType

    known = F.lit(None).cast("map<string,string>")
    if digests is not None and _holds(t, "", _is_reference_at):
        # the outer form, as Spark puts a filter below the other that works the whole array out twice more
        full = F.struct(*fields)
        asked = records.select(F.col(key).alias("of"), F.explode_outer(_missing(full, records.select(full).schema[0].dataType)).alias("record_id")).where("record_id IS NOT NULL")
        told = digests.where("record_id IS NOT NULL AND semantic_digest IS NOT NULL").groupBy("record_id").agg(F.min("semantic_digest").alias("semantic_digest"))
        strong = is_digest(F.col("semantic_digest"))
        told = told.select("record_id", F.when(strong, F.unhex("semantic_digest")).alias("bytes"), F.when(~strong, F.col("semantic_digest")).alias("text"))
        told = told.repartition("record_id", "bytes")  # so that the join can split an id that many ask for
        found = asked.join(told, "record_id").select("of", "record_id", "bytes", "text").repartition("of")  # dealt before they are texts again
        each = F.struct("record_id", F.coalesce(F.lower(F.hex("bytes")), "text").alias("semantic_digest"))
        found = found.groupBy("of").agg(F.map_from_entries(F.collect_list(each)).alias("known_digests"))
        rows, known = rows.join(found, "of", "left"), F.col("known_digests")
    digest = lambda r: F.when(F.coalesce(r["semantic_digest"], F.lit("")) != "", r["semantic_digest"]).otherwise(F.try_element_at(known, r["record_id"]))

    identities = F.create_map().cast("map<string,string>")
    odd_set = weak_asset = F.lit(False)
    if kind == "product":
        placed = lambda c: F.struct(F.encode(c.cast("string"), "UTF-16BE").alias("place"), c.cast("string").alias("asset_id"))
        if asset_identities is not None:
            each = F.struct(placed(F.col("asset_id")).alias("asset"), "content_identity")
            pairs = asset_identities.groupBy(F.col(key).alias("of")).agg(F.sort_array(F.collect_list(each)).alias("identity_rows"))
            rows = rows.join(pairs, "of", "left")
            given = F.transform("identity_rows", lambda g: F.struct(g["asset"]["asset_id"].alias("asset_id"), g["content_identity"].alias("content_identity")))
            given = F.coalesce(given, F.array().cast("array<struct<asset_id:string,content_identity:string>>"))
        else:
            given = F.array().cast("array<struct<asset_id:string,content_identity:string>>")
        names = F.sort_array(F.transform(F.coalesce("own_assets", F.array().cast(rows.schema["own_assets"].dataType)), lambda a: placed(a["asset_id"])))["asset_id"]
        rows = rows.withColumns({"given": given, "asset_names": names})
        told = F.transform("given", lambda g: g["asset_id"])
        odd_set = ~told.eqNullSafe(F.array_distinct("asset_names"))
        weak_asset = F.exists("given", lambda g: ~ok(g["content_identity"]))
        identities = F.when(~odd_set, F.map_from_entries(F.col("given")))

    is_json = lambda kind_, path: path in JSON[kind] and isinstance(kind_, T.StringType)
    weak = _exists(F.col("record"), t, "", _is_reference_at, lambda c: c.isNotNull() & ~ok(digest(c)))
    broken = _exists(F.col("record"), t, "", is_json, lambda c: c.isNotNull() & F.try_parse_json(c).isNull())
    reason = F.when(odd_set, "ASSET_SET").when(weak_asset, "ASSET_WEAK").when(weak, "REFERENCE_WEAK").when(broken, "MATERIAL_JSON")
    rows = rows.withColumns({"reason": reason, "identities": identities})

    said = {_renamed(f.name, f.dataType): _rewritten(F.col("record")[f.name], f.dataType, f.name, kind, digest) for f in t}
    if kind == "product":
        own_asset = rows.schema["own_assets"].dataType.elementType
        said["assets"] = F.transform("own_assets", lambda a: _object({f.name: _rewritten(a[f.name], f.dataType, f"assets.{f.name}", kind, digest) for f in own_asset} | {"content_identity": F.try_element_at(F.col("identities"), a["asset_id"].cast("string"))}))
        said = {"extensions": said.pop("extensions"), "product": _object(said), "schema_id": F.lit(MATERIAL_SCHEMA), "schema_version": F.lit(MATERIAL_VERSION)}
    written = {"ignoreNullFields": "false"}
    text = F.when(F.col("reason").isNull(), F.to_json(_object(said), written))
    # identities are in the order of their keys already
    return rows.select(F.col("of").alias(key), *also, text.alias("material"), F.to_json("identities", written).alias("assets"), "reason")


def product_content(products: DataFrame, key: str = "product_id", digests: DataFrame | None = None, asset_identities: DataFrame | None = None, domain: str = CONTENT_DOMAIN) -> DataFrame:
    """``(key, content_digest, reason)``: products that say the same, wherever and however large their files lie, have one digest."""
    out = material(products, "product", key, digests, asset_identities)
    return out.select(key, F.when(F.col("reason").isNull(), domain_digest(domain, F.col("material"))).alias("content_digest"), "reason")


def artifact_identity(records: dict[str, DataFrame], producers: DataFrame, digests: DataFrame | None = None, asset_identities: DataFrame | None = None, domain: str = ARTIFACT_DOMAIN) -> DataFrame:
    """``(record_type, record_id, identity, refused)`` of results of all four types.

    ``records``: per type (a key of :data:`FIELDS`) its rows with record_id, schema_id and schema_version; products may have
    ``structure_valid``. ``producers``: record_type, record_id, recipe, port and the ordered ``inputs`` of
    :func:`runloom.functions.digests.input_identities`. ``asset_identities``: record_id, asset_id, content_identity.

    ``refused`` is the first of RESULT_OUTPUT_PORT, RESULT_ASSETS (identities that aren't the product's assets', or of a
    record that isn't a product), RESULT_PRODUCT_STRUCTURE and RESULT_SEMANTIC_MATERIAL; such a record has no
    identity. Else what is weak first is the reason: the recipe, the inputs, the content. A digest covers schema,
    profile, recipe, port, material, asset identities and the order of inputs.
    """
    parts, text_id = [], F.col("record_id").cast("string")
    whole_numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    head = ["schema_id", "schema_version", "profile_id", "profile_version", "valid"]
    for kind, rows in records.items():
        own = lambda name, kind_of: F.col(name).cast(kind_of) if kind == "product" else F.lit(None).cast(kind_of)  # noqa: B023, E731
        valid = F.coalesce(F.col("structure_valid"), F.lit(False)) if kind == "product" and "structure_valid" in rows.columns else F.lit(True)
        # everything meets on ids of one type, so that a record is shuffled once: as they are if all are the same whole numbers, else as texts
        given_ids = [x.schema["record_id"].dataType for x in (rows, producers, asset_identities) if x is not None]
        own_id = F.col("record_id") if isinstance(given_ids[0], whole_numbers) and len(set(given_ids)) == 1 else text_id
        rows = rows.withColumns({"record_id": own_id, "profile_id": own("profile_id", "string"), "profile_version": own("profile_version", "int"), "valid": valid})
        mine = None if asset_identities is None else asset_identities.withColumn("record_id", own_id)
        said = material(rows, kind, "record_id", digests, mine if kind == "product" else None, strict=True, also=head)
        both = said.withColumn("record_type", F.lit(kind))
        if kind != "product" and mine is not None:
            some = mine.select("record_id", F.lit("ASSET_SET").alias("has_assets")).distinct()
            both = both.join(some, "record_id", "left").withColumn("reason", F.coalesce("has_assets", "reason")).drop("has_assets")
        made_by = producers.where(F.col("record_type") == kind).select(own_id.alias("record_id"), "recipe", "port", "inputs")
        parts.append(both.join(made_by, "record_id", "left").withColumn("record_id", text_id))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    port_ok = F.coalesce(F.col("port").rlike(r"\A\S(.*\S)?\z"), F.lit(False))
    refused = (
        F.when(~port_ok, "RESULT_OUTPUT_PORT").when(F.col("reason") == "ASSET_SET", "RESULT_ASSETS").when(~F.col("valid"), "RESULT_PRODUCT_STRUCTURE").when(F.col("reason") == "MATERIAL_JSON", "RESULT_SEMANTIC_MATERIAL")
    )
    weak = F.when(~F.coalesce(is_digest(F.col("recipe")), F.lit(False)), "RESULT_RECIPE_WEAK").when(F.col("inputs").isNull(), "RESULT_INPUT_IDENTITY_WEAK").when(F.col("material").isNull(), "RESULT_CONTENT_IDENTITY_WEAK")
    head = canonical(ordered_input_lineage=F.col("inputs"), output_port=F.col("port"), producer_task_fingerprint=F.col("recipe"), profile_id=F.col("profile_id"), profile_version=F.col("profile_version"), schema_id=F.col("schema_id"), schema_version=F.col("schema_version"))
    # material and assets are canonical texts already, and their keys are the last ones
    whole = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"scientific_asset_content_identities":'), F.coalesce("assets", F.lit("null")), F.lit(',"typed_semantic_projection":'), "material", F.lit("}"))
    rows = rows.withColumns({"refused": refused, "weak": weak})
    sound = F.col("refused").isNull() & F.col("weak").isNull()
    rows = with_fingerprint(rows, "identity", domain_digest(domain, F.when(sound, whole)), F.when(F.col("weak").isNull(), F.array().cast("array<string>")).otherwise(F.array("weak")))
    return rows.select("record_type", "record_id", F.when(F.col("refused").isNull(), F.col("identity")).alias("identity"), "refused")
