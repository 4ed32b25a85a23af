"""Checks of nested product records: duplicates, references, shapes, cardinality, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.exprs import is_identifier, is_namespaced
from runloom.operators.issues import ERROR, all_issues, issue
from runloom.sources.shared import dealt, small

CHILDREN = ("assets", "layers", "geometries", "lineage", "acquisition_refs")


def explode_products(products: DataFrame, key: str = "product_id", children: tuple[str, ...] = CHILDREN) -> dict[str, DataFrame]:
    """A table per child array (``key, pos`` and its fields), one for axes and one per attribute map."""
    out = {}
    for child in children:
        if child in products.columns:
            out[child] = products.select(key, F.posexplode(child).alias("pos", "item")).select(key, "pos", "item.*")
    if "geometries" in out and "axes" in out["geometries"].columns:
        out["axes"] = out["geometries"].select(key, "geometry_id", F.posexplode("axes").alias("pos", "item")).select(key, "geometry_id", "pos", "item.*")
    for attributes in ("semantic_metadata", "extensions"):
        if attributes in products.columns:
            out[attributes] = products.select(key, F.explode(attributes).alias("name", "value"))
    return out


def check_duplicates(child: DataFrame, parent: str, keys: list[str], order: list[str], code: str) -> DataFrame:
    """An issue for every repeat after the first of ``keys`` inside ``parent``, at its position."""
    w = Window.partitionBy(parent, *keys).orderBy(*order)
    rows = child.withColumn("nth", F.row_number().over(w)).where("nth > 1")
    return rows.select(F.col(parent).cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit(code).alias("code"), F.concat_ws(".", *order).alias("location"))


def check_references(source: DataFrame, target: DataFrame, on: dict[str, str], subject: str, location: str, code: str, when: Column | None = None) -> DataFrame:
    """An issue for every row of ``source`` (where ``when`` holds) without a match in ``target``.

    ``on`` maps columns of ``source`` to those of ``target``; both sides are reduced to them first.
    """
    rows = source if when is None else source.where(when)
    known = target.select(*[F.col(t).alias(s) for s, t in on.items()]).distinct()
    # not an anti join: Spark would push that below the dealing of rows
    lost = rows.join(known.withColumn("reference_known", F.lit(True)), list(on), "left").where("reference_known IS NULL")
    return lost.select(F.col(subject).cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit(code).alias("code"), F.col(location).cast("string").alias("location"))


def check_layers(layers: DataFrame, assets: DataFrame, geometries: DataFrame) -> DataFrame:
    """Layer references inside one product: assets, known geometries, mask layers."""
    mine = {"product_id": "product_id"}
    layers, assets, geometries = (dealt(df, "product_id") for df in (layers, assets, geometries))
    found = check_references(layers, assets, mine | {"asset_id": "asset_id"}, "product_id", "layer_id", "missing-asset-reference", F.col("asset_id").isNotNull())
    known = layers.where(F.col("geometry_ref.status") == "known").select("product_id", "layer_id", F.col("geometry_ref.value").alias("geometry_id"))
    found = found.unionByName(check_references(known, geometries, mine | {"geometry_id": "geometry_id"}, "product_id", "layer_id", "missing-geometry-reference"))
    masks = layers.where((F.col("nodata.status") == "known") & (F.col("nodata.value.kind") == "mask")).select("product_id", "layer_id", F.col("nodata.value.mask_layer_ref").alias("mask"))
    return found.unionByName(check_references(masks, layers, mine | {"mask": "layer_id"}, "product_id", "layer_id", "missing-mask-layer-reference"))


def check_geometry(geometries: DataFrame, subject: str = "product_id", geometry: str = "geometry_id", axes: str = "axes", shape: str = "shape", axis_id: Column | None = None) -> DataFrame:
    """Empty geometries, axes and shape of different length, sizes that aren't positive, repeated axes."""
    ids = F.transform(axes, lambda a: a["axis_id"]) if axis_id is None else axis_id
    at = F.col(geometry)
    n, m = F.size(ids), F.size(shape)
    return all_issues(
        geometries,
        F.col(subject),
        issue((n <= 0) & (m <= 0), "empty-geometry", at),
        issue(n != m, "geometry-axis-count-mismatch", at),
        issue(F.exists(shape, lambda s: s.isNull() | (s <= 0)), "invalid-geometry-shape", at),
        issue(F.size(F.array_distinct(ids)) < n, "duplicate-axis-id", at),
    )


def check_dimensions(layers: DataFrame, geometries: DataFrame, geometry_issues: DataFrame) -> DataFrame:
    """Layers whose dimensions aren't the ordered axes of their geometry.

    Geometries that have issues of their own are left out, so one mistake isn't reported twice.
    ``layers``: product_id, layer_id, geometry_id, dimensions; ``geometries``: product_id, geometry_id,
    axis_ids.
    """
    bad = geometry_issues.select(F.col("subject_id").alias("s"), F.col("location").alias("g")).distinct()
    good = geometries.join(bad, (geometries["product_id"].cast("string") == bad["s"]) & (geometries["geometry_id"].cast("string") == bad["g"]), "left_anti")
    rows = layers.join(good.select("product_id", "geometry_id", "axis_ids"), ["product_id", "geometry_id"])
    return all_issues(rows, F.col("product_id"), issue(~F.col("dimensions").eqNullSafe(F.col("axis_ids")), "layer-dimensions-geometry-mismatch", F.col("layer_id")))


def asset_matches() -> Column:
    """Member side ``m`` against requirement side ``r``."""
    kinds = F.col("r.allowed_kinds")
    return kinds.isNull() | (F.size(kinds) == 0) | F.array_contains(kinds, F.col("m.asset_kind"))


def geometry_matches() -> Column:
    roles, have = F.col("r.required_axis_roles"), F.col("m.axis_roles")
    needs = lambda flag, status: ~F.coalesce(F.col(f"r.{flag}"), F.lit(False)) | (F.col(f"m.{status}") == "known")
    return (
        (F.col("r.domain_id").isNull() | (F.col("m.domain") == F.col("r.domain_id")))
        & (roles.isNull() | (F.size(F.array_except(roles, have)) == 0))
        & needs("require_known_registration", "registration_status")
        & needs("require_known_coordinate_reference", "coordinate_reference_status")
    )


def layer_matches() -> Column:
    """Layers carry ``<field>_status`` and ``<field>_value`` columns, and the domain of their geometry."""
    ok = (F.col("r.role").isNull() | (F.col("m.role") == F.col("r.role"))) & (F.col("r.selector_kind").isNull() | F.coalesce(F.col("m.selector_format") == F.col("r.selector_kind"), F.lit(False)))
    for flag, field, want in (("require_known_quantity", "quantity", "quantity_kind"), ("require_known_unit", "unit", "unit_id"), ("require_known_sign", "sign", "sign_convention_id")):
        known = F.col(f"m.{field}_status") == "known"
        ok = ok & (~F.coalesce(F.col(f"r.{flag}"), F.lit(False)) | known) & (F.col(f"r.{want}").isNull() | (known & (F.col(f"m.{field}_value") == F.col(f"r.{want}"))))
    ok = ok & (~F.coalesce(F.col("r.require_known_geometry"), F.lit(False)) | (F.col("m.geometry_status") == "known"))
    return ok & (F.col("r.geometry_domain_id").isNull() | F.coalesce(F.col("m.geometry_domain") == F.col("r.geometry_domain_id"), F.lit(False)))


def check_cardinality(products: DataFrame, requirements: DataFrame, members: DataFrame, matches: Column, code: str, product: str = "product_id", on: list[str] | None = None) -> DataFrame:
    """Requirements whose number of matching members lies outside [min_count, max_count].

    ``products`` and ``requirements`` meet on ``on`` (profile columns); members are counted per product
    and requirement through an equi-join on the product with ``matches`` as its residual condition, so
    products without any member count as zero.
    """
    on = on or ["profile_id", "profile_version"]
    asked = dealt(products.select(product, *on), product).join(small(requirements), on)
    r, m = asked.alias("r"), dealt(members.withColumn("member_found", F.lit(1)), product).alias("m")
    joined = r.join(m, (F.col(f"r.{product}") == F.col(f"m.{product}")) & F.coalesce(matches, F.lit(False)), "left")
    n = joined.groupBy(F.col(f"r.{product}").alias("subject"), F.col("r.requirement_id").alias("requirement_id"), F.col("r.min_count").alias("min_count"), F.col("r.max_count").alias("max_count")).agg(F.count("m.member_found").alias("observed_count"))
    out = n.where("observed_count < min_count OR observed_count > max_count")
    return out.select(
        F.col("subject").cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit(code).alias("code"), F.col("requirement_id").alias("location"), "observed_count"
    )


def check_profile(products: DataFrame, profiles: DataFrame) -> DataFrame:
    """Products whose profile id or version isn't the expected one, or whose kind it doesn't allow.

    ``profiles``: product_kind_group, profile_id, profile_version, allowed_product_kinds; ``products`` name
    the profile they are held against in ``expected_profile``.
    """
    p = profiles.select(F.col("profile_id").alias("expected_profile"), F.col("profile_version").alias("want_version"), "allowed_product_kinds")
    rows = products.join(p, "expected_profile")
    return all_issues(
        rows,
        F.col("product_id"),
        issue(~F.col("profile_id").eqNullSafe(F.col("expected_profile")), "profile-id-mismatch", "profile_id"),
        issue(~F.col("profile_version").eqNullSafe(F.col("want_version")), "profile-version-mismatch", "profile_version"),
        issue((F.size("allowed_product_kinds") > 0) & ~F.array_contains("allowed_product_kinds", F.col("product_kind")), "product-kind-not-allowed", "product_kind"),
    )


def check_lineage(lineage: DataFrame, parent: str, role: str, record: str, reference: Column) -> DataFrame:
    """(role, record) pairs that carry different references; equal repeats are data, not conflicts."""
    rows = dealt(lineage.select(parent, role, record, reference.alias("reference")), parent, role, record)
    n = rows.groupBy(parent, role, record).agg(F.min("reference").alias("low"), F.max("reference").alias("high")).where("low <> high")
    return n.select(F.col(parent).cast("string").alias("subject_id"), F.lit(ERROR).alias("kind"), F.lit("lineage-conflict").alias("code"), F.concat_ws(":", role, record).alias("location"))


def check_envelope(records: DataFrame, schema_id: str, schema_version: int, subject: str = "product_id") -> DataFrame:
    """Schema identity, availability of the producer's identity, grammar of extension keys.

    Columns: schema_id, schema_version, execution_status, execution_value, execution_reason, extensions.
    """
    status = F.col("execution_status")
    known = (status == "known") & F.coalesce(F.trim("execution_value") != "", F.lit(False))
    unknown = (status == "unknown") & F.coalesce(is_identifier(F.col("execution_reason")), F.lit(False))
    return all_issues(
        records,
        F.col(subject),
        issue(F.coalesce(F.col("schema_id") != schema_id, F.lit(True)), "schema-mismatch", "schema_id"),
        issue(F.coalesce(F.col("schema_version") != schema_version, F.lit(True)), "version-mismatch", "schema_version"),
        issue(~F.coalesce(known | unknown, F.lit(False)), "producer-identity", "execution"),
        issue(F.exists(F.coalesce(F.map_keys("extensions"), F.array().cast("array<string>")), lambda k: ~is_namespaced(k)), "extension-key", "extensions"),
    )


def catalog_entries(snapshots: DataFrame, entries: str = "entries", subject: str = "snapshot_id") -> tuple[DataFrame, DataFrame]:
    """(entry rows, issues): unique entry ids; a reason unless the entry is available."""
    rows = snapshots.select(subject, F.posexplode(entries).alias("pos", "e")).select(subject, "pos", "e.*")
    found = check_duplicates(rows, subject, ["entry_id"], ["pos"], "duplicate-entry-id")
    reason = F.coalesce(is_identifier(F.col("reason_code")), F.lit(False))
    return rows, found.unionByName(all_issues(rows, F.col(subject), issue((F.col("availability") != "available") & ~reason, "access-reason-missing", F.col("entry_id"))))


def qc_tables(reports: DataFrame, subject: str = "report_id") -> dict[str, DataFrame]:
    """Metrics, findings, issues and counts by status of quality reports."""
    metrics = reports.select(subject, F.posexplode("metrics").alias("pos", "m")).select(subject, "pos", "m.*")
    findings = reports.select(subject, F.posexplode("findings").alias("pos", "f")).select(subject, "pos", "f.*")
    return {
        "metrics": metrics,
        "findings": findings,
        "issues": check_duplicates(metrics, subject, ["metric_id"], ["pos"], "duplicate-metric-id"),
        "by_status": reports.groupBy("status").agg(F.count("*").alias("n_reports")),
    }


def acquisition_attributes(records: DataFrame, key: str = "record_id", attributes: str = "attributes") -> DataFrame:
    """A row per attribute, with its status, value and reason."""
    return records.select(key, F.explode(attributes).alias("name", "v")).select(key, "name", "v.status", "v.value", "v.reason_code")


