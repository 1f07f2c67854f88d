"""Reading one path of a VARIANT event into a typed cell.

A cell keeps the JSON kind next to the value, so a rule never compares a text with a number:
``try_variant_get`` alone would turn the text "1000" into the number 1000.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell kinds. NO_PARENT: the object that should hold the field is absent or not an object.
NO_PARENT, NULL, INTEGER, FRACTION, TEXT, BOOL, ARRAY, OTHER = range(-1, 7)

SCALAR_TYPE = "struct<kind:int,i:bigint,d:double,s:string>"
CELL_TYPE = f"struct<kind:int,i:bigint,d:double,s:string,items:array<{SCALAR_TYPE}>>"

_PARENT = r"^(.*)(?:\.[^.\[\]]+|\['[^']*'\])$"


def json_path(path: Column) -> Column:
    """``metadata.source`` or ``['a.b'].c`` as a JSON path."""
    return F.when(path.startswith("["), F.concat(F.lit("$"), path)).otherwise(F.concat(F.lit("$."), path))


def parent_path(path: Column) -> Column:
    """The enclosing object's path, empty for a top-level field."""
    return F.regexp_extract(path, _PARENT, 1)


def bind(value: Column, body) -> Column:
    """``body`` over ``value`` computed once, usable inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _get(root: Column, path: Column, type_name: str) -> Column:
    return F.call_function("try_variant_get", root, path, F.lit(type_name))


def is_object(value: Column) -> Column:
    return _get(value, F.lit("$"), "map<string,variant>").isNotNull()


def _scalar(value: Column, parent_ok: Column) -> Column:
    root = F.lit("$")

    def with_tag(tag):
        fraction = tag.startswith("DECIMAL") | tag.isin("DOUBLE", "FLOAT")
        kind = (
            F.when(value.isNull(), F.when(parent_ok, F.lit(NULL)).otherwise(F.lit(NO_PARENT)))
            .when(tag == "BIGINT", F.lit(INTEGER))
            .when(tag == "STRING", F.lit(TEXT))
            .when(fraction, F.lit(FRACTION))
            .when(tag == "BOOLEAN", F.lit(BOOL))
            .when(tag == "VOID", F.lit(NULL))
            .when(tag.startswith("ARRAY"), F.lit(ARRAY))
            .otherwise(F.lit(OTHER))
        )
        return F.struct(
            kind.alias("kind"),
            F.when(tag == "BIGINT", _get(value, root, "bigint")).alias("i"),
            F.when(fraction, _get(value, root, "double")).alias("d"),
            F.when(tag.isin("STRING", "BOOLEAN"), _get(value, root, "string")).alias("s"),
        )

    return bind(F.schema_of_variant(value), with_tag)


def _holder_is_object(root: Column, path: Column) -> Column:
    parent = parent_path(path)
    return (parent == "") | _get(root, json_path(parent), "map<string,variant>").isNotNull()


def scalar_cell(root: Column, path: Column) -> Column:
    """Cell of a field that is compared with a literal."""
    no_items = F.lit(None).cast(f"array<{SCALAR_TYPE}>")
    return bind(
        _get(root, json_path(path), "variant"),
        lambda v: bind(
            _scalar(v, _holder_is_object(root, path)),
            lambda s: F.struct(s["kind"].alias("kind"), s["i"].alias("i"), s["d"].alias("d"), s["s"].alias("s"), no_items.alias("items")),
        ),
    )


def array_cell(root: Column, path: Column, item: Column) -> Column:
    """Cell of an array whose elements' field ``item`` is compared with a literal."""
    elements = _get(root, json_path(path), "array<variant>")
    items = F.transform(elements, lambda e: bind(_get(e, json_path(item), "variant"), lambda v: _scalar(v, is_object(e))))
    return bind(
        items,
        lambda found: F.struct(
            F.when(found.isNotNull(), F.lit(ARRAY))
            .when(_holder_is_object(root, path), F.lit(NULL))
            .otherwise(F.lit(NO_PARENT))
            .alias("kind"),
            F.lit(None).cast("bigint").alias("i"),
            F.lit(None).cast("double").alias("d"),
            F.lit(None).cast("string").alias("s"),
            found.alias("items"),
        ),
    )


def any_cell(root: Column, path: Column, item: Column) -> Column:
    """Cell for a path known only at run time (``item`` null for a plain field)."""
    return F.when(item.isNotNull(), array_cell(root, path, item)).otherwise(scalar_cell(root, path))
