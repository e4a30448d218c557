"""Contracts: documents are checked as a whole and every fault is named by its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NumericType, StructType

MANIFEST_ITEM = {"id": "string", "dataset": "string", "path": "string", "duration_s": "number", "reference": "string"}


def fault(document: Column, path: str, kind: str, required: bool) -> Column:
    """What is wrong with one field of a VARIANT, or null: `string` (required ones not empty), `number` (0 or more), `boolean`."""
    found = F.try_variant_get(document, f"$.{path}", "string")
    shape = F.schema_of_variant(F.try_variant_get(document, f"$.{path}", "variant"))
    absent = F.coalesce(shape, F.lit("VOID")) == "VOID"
    number = shape.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    right = {"string": shape == "STRING", "number": number & (F.try_variant_get(document, f"$.{path}", "double") >= 0), "boolean": shape == "BOOLEAN"}[kind]
    if required and kind == "string":
        right = right & (F.length(found) > 0)
    wrong = ~F.coalesce(right, F.lit(False)) & (F.lit(True) if required else ~absent)
    return F.when(wrong, F.lit(f"{path}: {kind}{' required' if required else ' or null'}"))


def faults(document: Column, required: dict[str, str], optional: dict[str, str], schema: int = 1) -> Column:
    """All faults of a JSON text, the version first: another version is the only fault named."""
    v = F.try_parse_json(document)
    version = F.try_variant_get(v, "$.schema", "int")
    each = [*[fault(v, p, k, True) for p, k in required.items()], *[fault(v, p, k, False) for p, k in optional.items()]]
    known = F.filter(F.array(*each), lambda x: x.isNotNull())
    return F.when(v.isNull(), F.array(F.lit("not JSON"))).when(~version.eqNullSafe(F.lit(schema)), F.array(F.lit(f"schema: {schema} expected"))).otherwise(known)


def manifest_items(documents: DataFrame, column: str = "document") -> DataFrame:
    """C4: the items of a manifest with their place; the first fault of an item raises and names it. Other keys are dropped."""
    listed = documents.select(F.posexplode(F.from_json(column, "struct<items:array<variant>>")["items"]).alias("ordinal", "item"))
    wrong = F.filter(F.array(*[fault(F.col("item"), p, k, True) for p, k in MANIFEST_ITEM.items()]), lambda x: x.isNotNull())
    stop = F.raise_error(F.concat(F.lit("items["), F.col("ordinal").cast("string"), F.lit("]."), F.get(wrong, F.lit(0))))
    get = lambda p, k: F.try_variant_get("item", f"$.{p}", "double" if k == "number" else "string")
    return listed.select(F.when(F.size(wrong) > 0, stop.cast("int")).otherwise(F.col("ordinal")).alias("ordinal"), *[get(p, k).alias(p) for p, k in MANIFEST_ITEM.items()])


def schema_faults(document: Column, schema: StructType) -> Column:
    """All faults of a JSON text against a declared schema, each by its path, as `items[3].name: string required`.

    Fields that aren't nullable are required. Strings that are required aren't empty, numbers are finite and 0 or more, whole where
    their type is; arrays and maps are checked in every element; further fields are let be."""
    v = F.try_parse_json(document)
    return F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(_value_faults(v, schema, True, F.lit("")))


def _value_faults(value: Column, kind: DataType, required: bool, path: Column) -> Column:
    """The faults of a VARIANT and of what is in it, as an array."""
    shape = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    none = F.array().cast("array<string>")
    dotted = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), name)
    each = lambda found: F.coalesce(F.flatten(found), none)
    if isinstance(kind, StructType):
        word, right = "object", F.startswith(shape, F.lit("OBJECT"))
        inner = [_value_faults(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, not f.nullable, dotted(F.lit(f.name))) for f in kind.fields]
        within = F.concat(*inner) if inner else none
    elif isinstance(kind, ArrayType):
        word, right = "array", F.startswith(shape, F.lit("ARRAY"))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        within = each(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _value_faults(x, kind.elementType, not kind.containsNull, at(i))))
    elif isinstance(kind, MapType):
        word, right = "object", F.startswith(shape, F.lit("OBJECT"))
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        within = each(F.transform(entries, lambda e: _value_faults(e["value"], kind.valueType, not kind.valueContainsNull, dotted(e["key"]))))
    elif isinstance(kind, BooleanType):
        word, right, within = "boolean", shape == "BOOLEAN", none
    elif isinstance(kind, NumericType):
        whole = isinstance(kind, IntegralType)
        number = F.try_variant_get(value, "$", "double")
        word, within = "whole number" if whole else "number", none
        right = shape.rlike("^BIGINT$" if whole else r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (number >= 0) & (number < float("inf"))
    else:
        word, within = "string", none
        right = shape == "STRING"
        right = right & (F.length(F.try_variant_get(value, "$", "string")) > 0) if required else right
    wrong = F.array(F.concat(F.when(path == "", "document").otherwise(path), F.lit(f": {word} {'required' if required else 'or null'}")))
    absent = F.lit(not required) & (shape == "VOID")
    return F.when(absent, none).when(F.coalesce(right, F.lit(False)), within).otherwise(wrong)


def key_paths(schema: DataType, prefix: str = "") -> set[str]:
    """The paths of all fields of a schema; arrays and maps count as *."""
    if isinstance(schema, StructType):
        return {p for f in schema.fields for p in {f"{prefix}{f.name}"} | key_paths(f.dataType, f"{prefix}{f.name}.")}
    inner = getattr(schema, "elementType", getattr(schema, "valueType", None))
    return key_paths(inner, f"{prefix}*.") if inner is not None else set()
