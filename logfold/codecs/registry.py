"""Codecs by encoding name: functions over DataFrames, so that users can add their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownCodecError
from ..plans import schema as S
from . import cdr, jsons, proto


@dataclass(frozen=True)
class Codec:
    """``decode(rows, column, type_name, schema, **options)`` gives ``rows`` with a column ``message``;
    ``encode(rows, column, type_name, schema, **options)`` gives them with a column ``data``."""

    decode: Callable[..., DataFrame]
    encode: Callable[..., DataFrame]


class Registry:
    def __init__(self):
        self.codecs: dict[str, Codec] = {}

    def register(self, encoding: str, codec: Codec) -> None:
        self.codecs[encoding.lower()] = codec

    def unregister(self, encoding: str) -> bool:
        return self.codecs.pop(encoding.lower(), None) is not None

    def has(self, encoding: str) -> bool:
        return encoding.lower() in self.codecs

    def get(self, encoding: str) -> Codec:
        if not self.has(encoding):
            raise UnknownCodecError(f"no codec for {encoding!r}")
        return self.codecs[encoding.lower()]

    def names(self) -> list[str]:
        return sorted(self.codecs)

    def __len__(self) -> int:
        return len(self.codecs)


def standard() -> Registry:
    """A registry with CDR, protobuf and JSON. A protobuf schema is the descriptor set's bytes."""
    out = Registry()
    out.register("cdr", Codec(lambda rows, column, name, schema, **o: cdr.decode(rows, column, S.parse(name, schema), **o), lambda rows, column, name, schema, **o: cdr.encode(rows, column, S.parse(name, schema), **o)))
    out.register("protobuf", Codec(lambda rows, column, name, schema, **o: proto.decode(rows, column, schema, name, **o), lambda rows, column, name, schema, **o: proto.encode(rows, column, schema, name, **o)))
    out.register("json", Codec(lambda rows, column, name, schema, **o: rows.withColumn("message", jsons.decode(F.col(column), **o)), lambda rows, column, name, schema, **o: rows.withColumn("data", jsons.encode(F.col(column)).cast("binary"))))
    return out
