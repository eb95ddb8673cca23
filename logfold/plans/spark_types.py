"""Spark types of schemas. Unsigned integers take the next wider type; 64 bits unsigned a decimal."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import UnsupportedError
from .schema import Array, Message, Prim, Schema

_TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "byte": T.ShortType(), "char": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "wstring": T.StringType(), "time": T.LongType(), "duration": T.LongType(),
}


def struct_type(schema: Schema, message: Message | None = None, seen: tuple[str, ...] = ()) -> T.StructType:
    message = message or schema.top
    if message.name in seen:
        raise UnsupportedError(f"{message.name!r} holds itself")

    def of(kind) -> T.DataType:
        if isinstance(kind, Prim):
            return _TYPES[kind.name]
        if isinstance(kind, Array):
            if kind.element in (Prim("uint8"), Prim("byte")):
                return T.BinaryType()
            return T.ArrayType(of(kind.element))
        return struct_type(schema, schema.resolve(kind.name, message.name), (*seen, message.name))

    return T.StructType([T.StructField(f.name, of(f.type)) for f in message.fields])
