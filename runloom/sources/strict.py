"""Strict reading of nested JSON: the first place that isn't what a schema asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS, TYPE = "RECORD_FIELDS", "RECORD_TYPE"


def _variants(t: T.DataType) -> str:
    """Pattern of the VARIANT types that a value of a type may have; null is always one."""
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, (T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return r"BIGINT|DOUBLE|DECIMAL\(.*\)"
    if isinstance(t, T.StringType):
        return "STRING"
    return r"ARRAY<.*>" if isinstance(t, T.ArrayType) else r"OBJECT<.*>"


def _fault(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"))


def _first(rows: Column) -> Column:
    return F.try_element_at(F.filter(rows, lambda x: x.isNotNull()), F.lit(1))


def first_fault(v: Column, t: T.DataType, free: frozenset[str] = frozenset(), path: Column | None = None, at: str = "") -> Column:
    """``struct<code, path>`` of the first place in a VARIANT that isn't what a type asks, null if there is none.

    A value must be of the kind asked for: a boolean is no number, a number with a fraction no integer, an integer
    must fit, a number is no string. Objects must have exactly the fields of their struct, whatever their order; maps any.
    Null stands for any value. A value that may be any JSON is named in ``free`` by its fields, without array
    and map places (``a.b``), an array of such values with brackets behind (``a.b[]``). Places are looked at from outside in and in the schema's order: an object's own fields
    come before what they hold. Paths are ``$.a[0].b``.
    """
    path = F.lit("$") if path is None else path
    if at in free:
        return F.lit(None).cast("struct<code:string,path:string>")
    kind = F.schema_of_variant(v)
    wrong = F.when(~kind.rlike(rf"\A(?:{_variants(t)}|VOID)\z"), _fault(TYPE, path))
    if isinstance(t, T.IntegerType):
        n = F.try_variant_get(v, "$", "long")
        return F.coalesce(wrong, F.when(~n.between(-(1 << 31), (1 << 31) - 1), _fault(TYPE, path)))
    if isinstance(t, T.StructType):
        keys, names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*[F.lit(f.name) for f in t]).cast("array<string>")
        unknown, missing = F.array_sort(F.array_except(keys, names)), F.array_except(names, keys)
        odd = lambda some: F.when(F.size(some) > 0, _fault(FIELDS, F.concat(path, F.lit("."), some[0])))
        inside = [first_fault(F.try_variant_get(v, f"$['{f.name}']", "variant"), f.dataType, free, F.concat(path, F.lit(f".{f.name}")), f"{at}.{f.name}" if at else f.name) for f in t]
        return F.coalesce(wrong, odd(unknown), odd(missing), *inside)
    if isinstance(t, T.ArrayType):
        if f"{at}[]" in free:
            return wrong
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: first_fault(x, t.elementType, free, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), at))
        return F.coalesce(wrong, _first(each))
    if isinstance(t, T.MapType):
        each = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: first_fault(e["value"], t.valueType, free, F.concat(path, F.lit("."), e["key"]), at))
        return F.coalesce(wrong, _first(each))
    return wrong
