"""Spark data sources over MCAP files and bags: ``logfold`` (messages), ``logfold_channels``, ``logfold_files``, ``logfold_attachments``.

Reading: the driver reads the summaries only; a partition is a run of neighbouring chunks of a file. Filters on topic,
channel_id and log_time that reach the source leave out whole chunks by their channels and times, and are handed back
to Spark, which applies them exactly. ``payload=false`` leaves the data column null without decompressing less.

Paths go through pyarrow's file systems, so stores other than the local one work where pyarrow knows them.

Streams: ``readStream`` takes the containers that arrive in a folder, each once.

Writing: one container per partition, under a temporary name until the job commits. Columns as read; channel columns
(topic, message_type, encoding, schema or schema_data, schema_encoding, callerid) stand beside each message. With
``table=attachments`` the rows are attachments (name, media_type, log_time, data).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import FormatError, UnsupportedError
from . import bag, mcap
from .detect import detect

ROWS = "file string, channel_id int, topic string, message_type string, encoding string, log_time long, publish_time long, sequence long, data binary, chunk_offset long"
CHANNELS = "file string, channel_id int, topic string, message_type string, encoding string, schema string, schema_encoding string, schema_data binary, callerid string, message_count long"
FILES = "path string, format string, size long, message_count long, n_channels int, n_chunks int, start_time long, end_time long, duration long"
ATTACHMENTS = "file string, name string, media_type string, log_time long, data binary"
#: Chunks are packed into partitions of about so many bytes of file.
PARTITION_BYTES = 64 << 20


def listing(path: str) -> list[tuple[pafs.FileSystem, str, int]]:
    """Files of a path: a file, or all containers below a folder, in order of name. Several paths stand with commas between."""
    out = []
    for one in path.split(","):
        system, inner = (pafs.FileSystem.from_uri(one) if "://" in one else (pafs.LocalFileSystem(), os.path.abspath(one.removeprefix("file:"))))
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FormatError(f"no file {one!r}")
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        out += [(system, f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and (f is info or f.path.lower().endswith((".mcap", ".bag")) and not os.path.basename(f.path).startswith(("_", ".")))]
    return out


def open_summary(system: pafs.FileSystem, path: str) -> tuple[str, mcap.Summary, dict[int, int]]:
    with system.open_input_file(path) as f:
        kind = detect(f.read(16), path)
        if kind == "mcap":
            return kind, mcap.summary(f), {}
        if kind == "bag":
            return kind, *bag.summary(f)
    raise FormatError(f"{path!r} is neither MCAP nor a bag")


@dataclass
class Part(InputPartition):
    """A run of chunks of one file, with what is needed to read it."""

    path: str
    kind: str
    chunks: list[tuple[int, int]]
    channels: dict[int, mcap.Channel]
    connections: dict[int, int]
    topics: frozenset[str] | None
    first: int | None
    last: int | None


class MessageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options.get("path", "")
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.schema = schema
        self.topics: set[str] | None = None
        self.ids: set[int] | None = None
        self.first: int | None = None
        self.last: int | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes note of what can leave out chunks; every filter goes back to be applied exactly."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            value = getattr(f, "value", None)
            if name in (("topic",), ("channel_id",)) and isinstance(f, (EqualTo, In)):
                some = {value} if isinstance(f, EqualTo) else set(value)
                at = "topics" if name == ("topic",) else "ids"
                setattr(self, at, some if getattr(self, at) is None else getattr(self, at) & some)
            elif name == ("log_time",) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = value if self.first is None else max(self.first, value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = value if self.last is None else min(self.last, value)
            yield f

    def partitions(self) -> list[Part]:
        return self.parts_of(listing(self.path)) or [Part("", "", [], {}, {}, None, None, None)]

    def parts_of(self, files: list[tuple[pafs.FileSystem, str, int]]) -> list[Part]:
        out = []
        for system, path, size in files:
            kind, found, connections = open_summary(system, path)
            wanted = {i for i, c in found.channels.items() if (self.topics is None or c.topic in self.topics) and (self.ids is None or i in self.ids)}
            picked = [c for c in found.chunks if self._wants(c, wanted)]
            parts = [(c.offset, c.length or _length(found.chunks, c, size)) for c in picked]
            parts += found.loose
            group: list[tuple[int, int]] = []
            uri = path if isinstance(system, pafs.LocalFileSystem) else next(p for p in self.path.split(",") if "://" in p).split("://")[0] + "://" + path
            channels = {i: c for i, c in found.channels.items() if i in wanted}
            for at, length in parts:
                group.append((at, length))
                if sum(n for _, n in group) >= self.bytes:
                    out.append(Part(uri, kind, group, channels, connections, None, self.first, self.last))
                    group = []
            if group:
                out.append(Part(uri, kind, group, channels, connections, None, self.first, self.last))
        return out

    def _wants(self, c: mcap.Chunk, wanted: set[int]) -> bool:
        if c.channels is not None and not c.channels & wanted:
            return False
        return not (self.first is not None and c.end < self.first or self.last is not None and c.start > self.last)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.chunks:
            return
        system, inner = (pafs.FileSystem.from_uri(part.path) if "://" in part.path else (pafs.LocalFileSystem(), part.path))
        arrow = to_arrow_schema(self.schema)
        with system.open_input_file(inner) as f:
            for at, length in part.chunks:
                rows = mcap.messages(f, at, length) if part.kind == "mcap" else bag.messages(f, at, part.connections)
                kept = [r for r in rows if r[0] in part.channels and (part.first is None or r[2] >= part.first) and (part.last is None or r[2] <= part.last)]
                if not kept:
                    continue
                ids, sequence, log, publish, data = zip(*kept, strict=True)
                own = [part.channels[i] for i in ids]
                columns = {
                    "file": [part.path] * len(ids),
                    "channel_id": ids,
                    "topic": [c.topic for c in own],
                    "message_type": [c.message_type for c in own],
                    "encoding": [c.encoding for c in own],
                    "log_time": log,
                    "publish_time": publish,
                    "sequence": sequence,
                    "data": data if self.payload else [None] * len(ids),
                    "chunk_offset": [at] * len(ids),
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in arrow], schema=arrow)


class MessageStream(DataSourceStreamReader):
    """A folder that finished containers arrive in: each batch reads those that came since the last one.

    An offset is the last file taken, in order of modification time and name. Writers publish whole files (as the sink
    here does), so a file is read once.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.reader = MessageReader(options, schema)

    def _arrived(self) -> list[tuple[list, tuple]]:
        found = [([system.get_file_info(path).mtime_ns or 0, path], (system, path, size)) for system, path, size in listing(self.reader.path)]
        return sorted(found, key=lambda f: f[0])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": [-1, ""]}

    def latestOffset(self) -> dict:  # noqa: N802
        arrived = self._arrived()
        return {"after": arrived[-1][0]} if arrived else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.reader.parts_of([f for key, f in self._arrived() if start["after"] < key <= end["after"]])

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return self.reader.read(part)


def _length(chunks: list[mcap.Chunk], c: mcap.Chunk, size: int) -> int:
    """A chunk's length where the index does not state it: up to the next one."""
    behind = [x.offset for x in chunks if x.offset > c.offset]
    return (min(behind) if behind else size) - c.offset


class TableReader(DataSourceReader):
    """Rows that come from the summaries: one partition per file."""

    def __init__(self, options: dict[str, str], schema: StructType, rows):
        self.path, self.schema, self.rows = options.get("path", ""), schema, rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((path, size, self.path)) for _, path, size in listing(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is None:
            return
        path, size, given = partition.value
        remote = next((p for p in given.split(",") if "://" in p), None)
        system = pafs.FileSystem.from_uri(remote)[0] if remote else pafs.LocalFileSystem()
        yield from self.rows(system, path, size)


def channel_rows(system, path, size):
    kind, found, _ = open_summary(system, path)
    counts = found.counts
    if not counts:  # nothing states the counts: take them from the messages
        counts = {}
        with system.open_input_file(path) as f:
            conns = bag.summary(f)[1] if kind == "bag" else {}
            for c in [(x.offset, x.length) for x in found.chunks] + found.loose:
                for m in mcap.messages(f, *c) if kind == "mcap" else bag.messages(f, c[0], conns):
                    counts[m[0]] = counts.get(m[0], 0) + 1
    for i, c in sorted(found.channels.items()):
        text = None if c.schema_encoding == "protobuf" else c.schema.decode("utf-8", "replace")
        yield path, i, c.topic, c.message_type, c.encoding, text, c.schema_encoding or None, c.schema, c.metadata.get("callerid"), counts.get(i, 0)


def file_rows(system, path, size):
    kind, found, _ = open_summary(system, path)
    start, end, n = found.start, found.end, found.message_count
    if n is None:
        n = sum(r[-1] for r in channel_rows(system, path, size))
        start, end = min((c.start for c in found.chunks), default=None), max((c.end for c in found.chunks), default=None)
    duration = end - start if start is not None and end is not None and end > start else 0
    yield path, kind, size, n, len(found.channels), len(found.chunks), start, end, duration


def attachment_rows(system, path, size):
    with system.open_input_file(path) as f:
        if detect(f.read(16), path) != "mcap":
            return
        for name, media, log, data in mcap.attachments(f):
            yield path, name, media, log, data


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    final: str | None
    messages: int


class MessageWriter(DataSourceWriter):
    """One container per non-empty partition; ``format``: mcap or bag; ``summary=false``: without a summary or index."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.format = options.get("format", "mcap").lower()
        self.compression = options.get("compression", "zstd" if self.format == "mcap" else "none")
        self.chunk = int(options.get("chunksize", options.get("chunkSize", (4 << 20) if self.format == "mcap" else (768 << 10))))
        self.level = int(options.get("compressionlevel", options.get("compressionLevel", 3)))
        self.summary = options.get("summary", "true").lower() != "false"
        if self.format not in ("mcap", "bag"):
            raise UnsupportedError(f"format {self.format!r}")
        self.names, self.overwrite, self.job = schema.names, overwrite, uuid.uuid4().hex[:12]
        self.attachments = options.get("table", "messages") == "attachments"
        if self.attachments and self.format != "mcap":
            raise UnsupportedError("attachments in a bag")
        for need in ("name", "media_type", "log_time", "data") if self.attachments else ("topic", "log_time", "data"):
            if need not in self.names:
                raise UnsupportedError(f"no column {need!r} to write")

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        final = os.path.join(self.path, f"part-{task.partitionId():05d}.{self.format}")
        temporary = os.path.join(self.path, f".{self.job}-{task.partitionId()}-{task.taskAttemptId()}")
        system, inner = (pafs.FileSystem.from_uri(temporary) if "://" in temporary else (pafs.LocalFileSystem(), temporary))
        if isinstance(system, pafs.LocalFileSystem):
            os.makedirs(self.path, exist_ok=True)
        n, out, f = 0, None, None
        ids: dict[tuple, int] = {}
        used: set[int] = set()
        free = iter(range(1 << 16))
        try:
            for row in rows:
                r = row.asDict()
                if out is None:
                    f = open(inner, "wb")  # a bag's header is written again at the end
                    out = mcap.Writer(f, self.chunk, self.compression, self.level) if self.format == "mcap" else bag.Writer(f, self.chunk, self.compression)
                n += 1
                if self.attachments:
                    out.add_attachment(r["name"] or "", r["media_type"] or "", r["log_time"] or 0, bytes(r["data"] or b""))
                    continue
                schema = r.get("schema_data") or (r.get("schema") or "").encode()
                key = (r["topic"], r.get("message_type") or "", r.get("encoding") or "", bytes(schema), r.get("schema_encoding") or "", r.get("callerid"))
                if key not in ids:
                    # Ids as read stay where they are free; others take the next free one.
                    wish = r.get("channel_id")
                    if wish is None or wish in used:
                        wish = next((i for i in free if i not in used), None)
                        if wish is None:
                            raise UnsupportedError("more than 65536 channels in a file")
                    ids[key] = wish
                    used.add(wish)
                    out.add_channel(mcap.Channel(ids[key], key[0], key[1], key[2], bytes(schema), key[4], metadata={"callerid": key[5]} if key[5] is not None else {}))
                publish = r.get("publish_time")
                out.write(ids[key], r["log_time"], r["log_time"] if publish is None else publish, bytes(r["data"] or b""), r.get("sequence"))
            if out is not None:
                out.finish(self.summary)
        finally:
            if f is not None:
                f.close()
        return Written(inner if out is not None else None, final, n)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        done = [m for m in messages if m is not None and m.path]
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.startswith("part-") and name.endswith((".mcap", ".bag")):
                    os.remove(os.path.join(self.path, name))
        for m in done:
            os.replace(m.path, m.final if self.overwrite or not os.path.exists(m.final) else m.final.replace("part-", f"part-{self.job}-"))

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.isdir(self.path):
            for name in os.listdir(self.path):
                if name.startswith(f".{self.job}-"):
                    os.remove(os.path.join(self.path, name))


class Messages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logfold"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MessageReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return MessageStream(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MessageWriter(dict(self.options), schema, overwrite)


def _table(label: str, ddl: str, rows) -> type[DataSource]:
    class Table(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return TableReader(dict(self.options), schema, rows)

    return Table


ChannelTable = _table("logfold_channels", CHANNELS, channel_rows)
FileTable = _table("logfold_files", FILES, file_rows)
AttachmentTable = _table("logfold_attachments", ATTACHMENTS, attachment_rows)


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session, with filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Messages, ChannelTable, FileTable, AttachmentTable):
        spark.dataSource.register(source)
    return spark
