"""Protobuf payloads: wire format without a schema, and with a descriptor set.

``from_protobuf`` of Spark needs a package that is not part of it; the installed ``google.protobuf`` runs in Arrow batches.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import BufferTooShortError, EncodeError, InvalidRuleError, ParseError, UnsupportedError


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data):
            raise BufferTooShortError("a varint is cut off")
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at
        if shift >= 64:
            raise ParseError("a varint is too long")


def decode_wire(data: bytes) -> dict[str, int | str | bytes]:
    """Field numbers with values: varints as signed 64 bits, fixed fields unsigned, lengths as text where they are UTF-8. The last of repeated fields stays."""
    out, at = {}, 0
    while at < len(data):
        tag, at = read_varint(data, at)
        key, wire = str(tag >> 3), tag & 7
        if wire == 0:
            value, at = read_varint(data, at)
            out[key] = value - (1 << 64) if value >> 63 else value
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise BufferTooShortError("a fixed field is cut off")
            out[key] = struct.unpack_from("<Q" if wire == 1 else "<I", data, at)[0]
            at += size
        elif wire == 2:
            n, at = read_varint(data, at)
            if at + n > len(data):
                raise BufferTooShortError("a field is cut off")
            part = data[at : at + n]
            at += n
            try:
                out[key] = part.decode()
            except UnicodeDecodeError:
                out[key] = part
        elif wire in (3, 4):
            raise UnsupportedError("groups")
        else:
            raise ParseError(f"wire type {wire}")
    return out


def wire_json(rows: DataFrame, column: str, into: str = "message") -> DataFrame:
    """``rows`` with the schema-less reading as JSON text (bytes in base64); ``parse_json`` makes a variant of it."""
    import base64

    at = rows.columns.index(column)
    out = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text(p):
            return None if p is None else json.dumps({k: base64.b64encode(v).decode() if isinstance(v, bytes) else v for k, v in decode_wire(p).items()}, ensure_ascii=False)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(text, batch.column(at).to_pylist()), pa.string())], names=names)

    return rows.mapInArrow(run, out)


def _class(descriptors: bytes, name: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    files = descriptor_pb2.FileDescriptorSet.FromString(descriptors)
    pool = descriptor_pool.DescriptorPool()
    for f in files.file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def _kind(field) -> T.DataType:
    """The Spark type of a field. Enums are numbers."""
    f = type(field)
    single = {
        f.TYPE_DOUBLE: T.DoubleType(), f.TYPE_FLOAT: T.FloatType(), f.TYPE_BOOL: T.BooleanType(), f.TYPE_STRING: T.StringType(), f.TYPE_BYTES: T.BinaryType(), f.TYPE_ENUM: T.IntegerType(),
        f.TYPE_INT32: T.IntegerType(), f.TYPE_SINT32: T.IntegerType(), f.TYPE_SFIXED32: T.IntegerType(), f.TYPE_UINT32: T.LongType(), f.TYPE_FIXED32: T.LongType(),
        f.TYPE_INT64: T.LongType(), f.TYPE_SINT64: T.LongType(), f.TYPE_SFIXED64: T.LongType(), f.TYPE_UINT64: T.DecimalType(20, 0), f.TYPE_FIXED64: T.DecimalType(20, 0),
    }.get(field.type)
    if field.type == f.TYPE_MESSAGE:
        if field.message_type.GetOptions().map_entry:
            return T.MapType(*(_kind(x) for x in field.message_type.fields))
        single = struct_type(field.message_type)
    if single is None:
        raise UnsupportedError(f"the type of {field.name!r}")
    return T.ArrayType(single) if field.is_repeated else single


def struct_type(descriptor) -> T.StructType:
    return T.StructType([T.StructField(f.name, _kind(f)) for f in descriptor.fields])


def _value(message, kind: T.StructType):
    from decimal import Decimal

    def one(v, k):
        if isinstance(k, T.StructType):
            return _value(v, k)
        return Decimal(v) if isinstance(k, T.DecimalType) else v

    out = {}
    for f in kind:
        v = getattr(message, f.name)
        if isinstance(f.dataType, T.ArrayType):
            out[f.name] = [one(x, f.dataType.elementType) for x in v]
        elif isinstance(f.dataType, T.MapType):
            out[f.name] = [(k, one(x, f.dataType.valueType)) for k, x in v.items()]
        else:
            out[f.name] = one(v, f.dataType)
    return out


def decode(rows: DataFrame, column: str, descriptors: bytes, name: str, into: str = "message") -> DataFrame:
    """``rows`` with the struct of a message type; unset fields have their defaults."""
    kind = struct_type(_class(descriptors, name).DESCRIPTOR)
    out = T.StructType([*rows.schema.fields, T.StructField(into, kind)])
    arrow = to_arrow_schema(T.StructType([T.StructField(into, kind)])).field(0).type
    at, names = rows.columns.index(column), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = _class(descriptors, name)
        for batch in batches:
            values = [None if p is None else _value(cls.FromString(p), kind) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=names)

    return rows.mapInArrow(run, out)


def encode(rows: DataFrame, column: str, descriptors: bytes, name: str, into: str = "data") -> DataFrame:
    """``rows`` with the payload of a struct column. Null fields stay unset."""
    out = T.StructType([*rows.schema.fields, T.StructField(into, T.BinaryType())])
    at, names = rows.columns.index(column), out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = _class(descriptors, name)
        for batch in batches:
            data = [None if v is None else _fill(cls(), v).SerializeToString(deterministic=True) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=names)

    return rows.mapInArrow(run, out)


def _fill(message, value: dict):
    from decimal import Decimal

    plain = lambda v: int(v) if isinstance(v, Decimal) else v
    for f in message.DESCRIPTOR.fields:
        v = value.get(f.name)
        if v is None:
            continue
        try:
            if f.type == f.TYPE_MESSAGE and f.message_type.GetOptions().map_entry:
                for k, x in v:
                    if isinstance(x, dict):
                        _fill(getattr(message, f.name)[k], x)
                    else:
                        getattr(message, f.name)[k] = plain(x)
            elif f.type == f.TYPE_MESSAGE and f.is_repeated:
                for x in v:
                    _fill(getattr(message, f.name).add(), x)
            elif f.type == f.TYPE_MESSAGE:
                _fill(getattr(message, f.name), v)
                getattr(message, f.name).SetInParent()
            elif f.is_repeated:
                getattr(message, f.name).extend(map(plain, v))
            else:
                setattr(message, f.name, plain(v))
        except (TypeError, ValueError) as e:
            raise EncodeError(str(e), f.name) from e
    return message


def rename(descriptors: bytes, old: str, new: str) -> bytes:
    """A descriptor set with a message type or a package renamed, references included; enums keep their names.

    A new message name may not have more dotted parts than the old one, and each part must be an identifier.
    """
    from google.protobuf import descriptor_pb2

    for part in new.split("."):
        if not part.isidentifier():
            raise InvalidRuleError(f"{part!r} is no identifier")
    files = descriptor_pb2.FileDescriptorSet.FromString(descriptors)
    packages = {f.package for f in files.file}
    whole = old in packages
    if not whole:
        if new.count(".") > old.count("."):
            raise InvalidRuleError(f"{new!r} is deeper than {old!r}")
        if old.rpartition(".")[0] != new.rpartition(".")[0]:
            raise InvalidRuleError("a message type cannot move to another package on its own")

    def moved(ref: str) -> str:
        bare = ref.removeprefix(".")
        if bare == old or bare.startswith(old + "."):
            return "." + new + bare[len(old) :]
        return ref

    def walk(message, scope: str) -> None:
        full = f"{scope}.{message.name}" if scope else message.name
        if not whole and full == old:
            message.name = new.rpartition(".")[2]
        for f in message.field:
            if f.type_name:
                f.type_name = moved(f.type_name)
        for n in message.nested_type:
            walk(n, full)

    for f in files.file:
        for m in f.message_type:
            walk(m, f.package)
        for s in f.service:
            for method in s.method:
                method.input_type, method.output_type = moved(method.input_type), moved(method.output_type)
        if whole and f.package == old:
            f.package = new
    return files.SerializeToString(deterministic=True)
