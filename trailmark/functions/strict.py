"""Type-gated reads from VARIANT: a wrong JSON type yields NULL, never a cast.

``try_variant_get(v, path, 'bigint')`` alone would turn ``2.0``, ``true`` and
``"2"`` into numbers, so each getter first checks the stored JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def json_type(v: Column, path: str = "$") -> Column:
    """BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, STRING, VOID (JSON null), OBJECT<..>,
    ARRAY<..>; NULL when the key is absent."""
    return F.schema_of_variant(child(v, path))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(json_type(v, path).startswith("ARRAY"), F.lit(False))


def _gated(v: Column, path: str, gate: Column, spark_type: str) -> Column:
    return F.when(gate, F.try_variant_get(v, path, spark_type))


def strict_string(v: Column, path: str) -> Column:
    return _gated(v, path, json_type(v, path) == "STRING", "string")


def strict_bool(v: Column, path: str) -> Column:
    return _gated(v, path, json_type(v, path) == "BOOLEAN", "boolean")


def strict_int(v: Column, path: str) -> Column:
    return _gated(v, path, json_type(v, path) == "BIGINT", "bigint")


def nonnegative_int(v: Column, path: str) -> Column:
    value = strict_int(v, path)
    return F.when(value >= 0, value)


def nonnegative_number(v: Column, path: str) -> Column:
    kind = json_type(v, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    value = _gated(v, path, numeric, "double")
    return F.when(value >= 0, value)


def shown_string(v: Column, path: str) -> Column:
    """Printable form used in count keys: absent -> NULL, JSON null -> 'None'."""
    kind = json_type(v, path)
    return (
        F.when(kind == "STRING", F.try_variant_get(v, path, "string"))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, path, "string")))
        .when(kind.isNotNull(), F.to_json(child(v, path)))
    )


def recorded_label(v: Column, path: str) -> Column:
    """A label as recorded: JSON null and absent are NULL, non-strings keep their JSON."""
    kind = json_type(v, path)
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string")).when(
        kind.isNotNull() & (kind != "VOID"), F.to_json(child(v, path))
    )


def is_blank(text: Column) -> Column:
    """No character but white space, of any script; NULL stays NULL."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")
