"""Chunk compression by name, in both container formats."""

from __future__ import annotations

import bz2

import pyarrow as pa

from ..errors import FormatError, UnsupportedError


def compress(name: str, data: bytes, level: int = 3) -> bytes:
    if name in ("", "none"):
        return data
    if name == "zstd":
        return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)
    if name == "lz4":
        return pa.Codec("lz4").compress(data, asbytes=True)
    if name == "bz2":
        return bz2.compress(data)
    raise UnsupportedError(f"compression {name!r}")


def decompress(name: str, data: bytes, size: int) -> bytes:
    """``size``: of the result. LZ4 frames are tried first, then blocks, with or without the size in front."""
    if name in ("", "none"):
        return data
    if name == "bz2":
        return bz2.decompress(data)
    if name == "zstd":
        return pa.decompress(data, size, "zstd", asbytes=True) if size else b""
    if name == "lz4":
        tries = [("lz4", data), ("lz4_raw", data), ("lz4_raw", data[4:])]
        for codec, part in tries:
            try:
                return pa.decompress(part, size, codec, asbytes=True)
            except (OSError, pa.ArrowException):
                continue
        raise FormatError("an LZ4 chunk cannot be read")
    raise UnsupportedError(f"compression {name!r}")
