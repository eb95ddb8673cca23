"""The ROS 1 bag container, version 2.0: records of named fields, chunks, an index at the end."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from ..errors import FormatError
from .compression import compress, decompress
from .mcap import Channel, Chunk, Summary

MAGIC = b"#ROSBAG V2.0\n"
#: The record types.
MESSAGE, BAG, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7


def fields(header: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at + 4 <= len(header):
        n = struct.unpack_from("<I", header, at)[0]
        name, _, value = header[at + 4 : at + 4 + n].partition(b"=")
        out[name.decode("latin-1")] = value
        at += 4 + n
    return out


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, bytes], int, int]]:
    """Offset, header fields, and start and end of the content of each record."""
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        if at + 8 + n > len(data):
            return
        size = struct.unpack_from("<I", data, at + 4 + n)[0]
        end = at + 8 + n + size
        if end > len(data):
            return
        yield at, fields(data[at + 4 : at + 4 + n]), at + 8 + n, end
        at = end


def _int(value: bytes) -> int:
    return int.from_bytes(value, "little")


def _time(value: bytes) -> int:
    sec, nanosec = struct.unpack("<II", value)
    return sec * 1_000_000_000 + nanosec


@dataclass
class Connection:
    id: int
    topic: str
    message_type: str = ""
    definition: str = ""
    callerid: str | None = None
    md5: str = ""


def _connection(head: dict[str, bytes], body: bytes) -> Connection:
    more = fields(body)
    text = lambda k, d=b"": more.get(k, d).decode("utf-8", "replace")
    return Connection(_int(head["conn"]), text("topic", head.get("topic", b"")), text("type"), text("message_definition"), text("callerid") if "callerid" in more else None, text("md5sum"))


def _head(f: BinaryIO, at: int) -> tuple[dict[str, bytes], int, int]:
    """Header fields of the record at an offset, where its content starts, and its size."""
    f.seek(at)
    n = struct.unpack("<I", _exactly(f, 4))[0]
    head = fields(_exactly(f, n))
    size = struct.unpack("<I", _exactly(f, 4))[0]
    return head, at + 8 + n, size


def _exactly(f: BinaryIO, n: int) -> bytes:
    out = f.read(n)
    if len(out) != n:
        raise FormatError("the bag is cut off")
    return out


def connections(f: BinaryIO) -> tuple[dict[int, Connection], list[Chunk], dict[int, int]]:
    """Connections, chunks, and message counts by connection where the index states them."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    if f.read(len(MAGIC)) != MAGIC:
        raise FormatError("no bag magic")
    head, start, length = _head(f, len(MAGIC))
    conns, chunks, counts = {}, [], {}
    index = _int(head.get("index_pos", b""))
    if len(MAGIC) < index < size:
        f.seek(index)
        data = f.read()
        for _, h, a, b in _records(data):
            op = _int(h.get("op", b""))
            if op == CONNECTION:
                c = _connection(h, data[a:b])
                conns[c.id] = c
            elif op == CHUNK_INFO:
                n = _int(h["count"])
                each = [struct.unpack_from("<II", data, a + 8 * i) for i in range(n)]
                for c, k in each:
                    counts[c] = counts.get(c, 0) + k
                chunks.append(Chunk(_int(h["chunk_pos"]), 0, _time(h["start_time"]), _time(h["end_time"]), frozenset(c for c, _ in each)))
        if conns:
            return conns, sorted(chunks, key=lambda c: c.offset), counts
    at = start + length
    while at + 8 <= size:
        try:
            h, a, n = _head(f, at)
        except FormatError:
            break
        if a + n > size:
            break
        op = _int(h.get("op", b""))
        if op == CONNECTION:
            f.seek(a)
            c = _connection(h, f.read(n))
            conns.setdefault(c.id, c)
        elif op == CHUNK:
            f.seek(a)
            data = decompress(h["compression"].decode(), f.read(n), _int(h["size"]))
            times = []
            for _, k, x, y in _records(data):
                kind = _int(k.get("op", b""))
                if kind == CONNECTION:
                    c = _connection(k, data[x:y])
                    conns.setdefault(c.id, c)
                elif kind == MESSAGE:
                    times.append(_time(k["time"]))
            chunks.append(Chunk(at, 0, min(times, default=0), max(times, default=0)))
        at = a + n
    return conns, chunks, {}


def summary(f: BinaryIO) -> tuple[Summary, dict[int, int]]:
    """The summary, and connection id -> channel id. Connections of a topic and caller share a channel; ids are dense in order of connections."""
    conns, chunks, counts = connections(f)
    ids: dict[tuple[str, str | None], int] = {}
    out, of = Summary(chunks=chunks), {}
    for n, c in sorted(conns.items()):
        key = (c.topic, c.callerid)
        if key not in ids:
            ids[key] = len(ids)
            extra = {"callerid": c.callerid} if c.callerid is not None else {}
            out.channels[ids[key]] = Channel(ids[key], c.topic, c.message_type, "ros1", c.definition.encode(), "ros1msg", metadata=extra)
        of[n] = ids[key]
        out.counts[ids[key]] = out.counts.get(ids[key], 0) + counts.get(n, 0)
    for chunk in chunks:
        if chunk.channels is not None:
            chunk.channels = frozenset(of[c] for c in chunk.channels if c in of)
    if counts:
        out.message_count = sum(counts.values())
        out.start, out.end = min((c.start for c in chunks), default=None), max((c.end for c in chunks), default=None)
    else:
        out.counts = {}
    return out, of


def messages(f: BinaryIO, offset: int, of: dict[int, int]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Channel, sequence 0, and twice the time, and data, of a chunk's messages. Those of unknown connections go."""
    head, at, n = _head(f, offset)
    f.seek(at)
    data = decompress(head["compression"].decode(), _exactly(f, n), _int(head["size"]))
    for _, h, a, b in _records(data):
        if _int(h.get("op", b"")) == MESSAGE and (c := _int(h["conn"])) in of:
            t = _time(h["time"])
            yield of[c], 0, t, t, bytes(data[a:b])


def _header(**named: bytes) -> bytes:
    out = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in named.items())
    return struct.pack("<I", len(out)) + out


def _record(head: bytes, body: bytes) -> bytes:
    return head + struct.pack("<I", len(body)) + body


def _stamp(ns: int) -> bytes:
    return struct.pack("<II", *divmod(ns, 1_000_000_000))


class Writer:
    """Writes a bag; connections are channels, one for each topic and caller."""

    def __init__(self, f: BinaryIO, chunk_size: int = 768 << 10, compression: str = "none"):
        self.f, self.chunk_size, self.compression = f, chunk_size, compression
        self.connections: dict[int, bytes] = {}
        self.infos: list[bytes] = []
        self.message_count = 0
        self._new_chunk()
        f.write(MAGIC + self._bag_header(0))

    def _bag_header(self, index: int) -> bytes:
        head = _header(op=bytes([BAG]), index_pos=struct.pack("<Q", index), conn_count=struct.pack("<I", len(self.connections)), chunk_count=struct.pack("<I", len(self.infos)))
        return _record(head, b" " * (4096 - len(head) - 4))

    def _new_chunk(self) -> None:
        self.buffer, self.seen, self.entries, self.span = bytearray(), set(), {}, None

    def add_channel(self, c: Channel) -> None:
        if c.id in self.connections:
            return
        more = {"topic": c.topic.encode(), "type": c.message_type.encode(), "md5sum": b"0" * 32, "message_definition": c.schema}
        if "callerid" in c.metadata:
            more["callerid"] = c.metadata["callerid"].encode()
        body = _header(**more)[4:]
        self.connections[c.id] = _record(_header(op=bytes([CONNECTION]), conn=struct.pack("<I", c.id), topic=c.topic.encode()), body)

    def write(self, channel: int, log_time: int, publish_time: int, data: bytes, sequence: int | None = None) -> None:
        if channel not in self.seen:
            self.seen.add(channel)
            self.buffer += self.connections[channel]
        self.entries.setdefault(channel, []).append((log_time, len(self.buffer)))
        self.buffer += _record(_header(op=bytes([MESSAGE]), conn=struct.pack("<I", channel), time=_stamp(log_time)), data)
        self.span = (log_time, log_time) if self.span is None else (min(self.span[0], log_time), max(self.span[1], log_time))
        self.message_count += 1
        if len(self.buffer) >= self.chunk_size:
            self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        at, data = self.f.tell(), bytes(self.buffer)
        self.f.write(_record(_header(op=bytes([CHUNK]), compression=self.compression.encode(), size=struct.pack("<I", len(data))), compress(self.compression, data)))
        counts = b""
        for c, entries in sorted(self.entries.items()):
            body = b"".join(_stamp(t) + struct.pack("<I", o) for t, o in entries)
            self.f.write(_record(_header(op=bytes([INDEX]), ver=struct.pack("<I", 1), conn=struct.pack("<I", c), count=struct.pack("<I", len(entries))), body))
            counts += struct.pack("<II", c, len(entries))
        first, last = self.span or (0, 0)
        head = _header(op=bytes([CHUNK_INFO]), ver=struct.pack("<I", 1), chunk_pos=struct.pack("<Q", at), start_time=_stamp(first), end_time=_stamp(last), count=struct.pack("<I", len(self.entries)))
        self.infos.append(_record(head, counts))
        self._new_chunk()

    def finish(self, with_summary: bool = True) -> None:
        self.flush()
        if not with_summary:
            return
        index = self.f.tell()
        for _, c in sorted(self.connections.items()):
            self.f.write(c)
        for i in self.infos:
            self.f.write(i)
        self.f.seek(len(MAGIC))
        self.f.write(self._bag_header(index))
        self.f.seek(0, 2)
