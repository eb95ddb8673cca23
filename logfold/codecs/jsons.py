"""JSON payloads as variants: built-in functions only.

A root that is no object stands under ``value``; a null root is an empty object. Integers are 64 bits signed where
they fit. Numbers that JSON cannot hold are errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variant types by the names of the value model.
_INTEGERS = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def decode(payload: Column, strict: bool = True) -> Column:
    """The variant of a JSON payload (text or UTF-8 bytes). Broken payloads raise, or give null if not ``strict``."""
    text = payload.cast("string")
    bare = F.trim(text)
    rooted = F.when(bare.startswith("{"), text).when(bare == "null", "{}").otherwise(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.parse_json(rooted) if strict else F.try_parse_json(rooted)


def encode(value: Column, pretty: bool = False) -> Column:
    return F.to_json(value, {"pretty": str(pretty).lower()})


def value(message: Column, path: str, kind: str) -> Column:
    """The value at a path if it has the type, else null."""
    return F.try_variant_get(message, path, kind)


def type_name(message: Column, path: str = "$") -> Column:
    """The type of the value at a path in the names of the value model."""
    at = F.variant_get(message, path, "variant")
    kind = F.schema_of_variant(at)
    return (
        F.when(kind.isin(*_INTEGERS), "int64")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float64")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "bool")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "struct")
        .when(kind == "VOID", "null")
    )


def is_numeric(name: Column) -> Column:
    return name.isin("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")


def is_integer(name: Column) -> Column:
    return is_numeric(name) & ~name.startswith("float")


def is_signed(name: Column) -> Column:
    return name.isin("int8", "int16", "int32", "int64")


def is_unsigned(name: Column) -> Column:
    return name.startswith("uint")


def is_float(name: Column) -> Column:
    return name.startswith("float")


def is_temporal(name: Column) -> Column:
    return name.isin("timestamp", "duration")


def is_container(name: Column) -> Column:
    return name.isin("array", "struct")


def temporal_text(ns: Column, kind: str) -> Column:
    """A time or duration as JSON payloads write it: ``Timestamp(n)`` or ``Duration(n)``."""
    return F.concat(F.lit("Timestamp(" if kind == "timestamp" else "Duration("), ns.cast("string"), F.lit(")"))
