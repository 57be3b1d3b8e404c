"""MCAP message logs as a Spark data source, written from the public format description.

register(spark); spark.read.format("mcap").load(path)
gives source, seq, topic, schema_name, encoding, log_ns, publish_ns, data; seq
ascends in the order of the file.  Files with a chunk index are cut into
partitions of whole chunks, which read only their own ranges; others are one
partition.  Options topics (a JSON list), start_ns and end_ns (half open) reach the
reader, as window() sets them: chunks outside the time bounds are neither read nor
unpacked.  They are options, not pushed filters, because Spark keeps a Python
source's pushed filters for later queries of the same DataFrame.  Chunks may be
unpacked, zstd or lz4 (if that module is there).  Paths are local or URIs of any
store that pyarrow opens; option chunk_index=required refuses files without an
index.
"""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x89MCAP0\r\n"
SCHEMA = "source string, seq long, topic string, schema_name string, encoding string, log_ns long, publish_ns long, data binary"
FOOTER_OP, SCHEMA_OP, CHANNEL_OP, MESSAGE_OP, CHUNK_OP, CHUNK_INDEX_OP, DATA_END_OP = 2, 3, 4, 5, 6, 8, 15
#: Bytes of chunks of a partition, and of messages of an Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Messages of a chunk: seq is the place of the chunk in the file, times this, and the message's number in it.
PER_CHUNK = 1 << 22
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())


def open_file(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(root)


def files(path: str) -> list[str]:
    """MCAP files below a folder or URI, sorted; a file is itself."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".mcap") and f.size)


def _text(data, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", data, at)
    return bytes(data[at + 4 : at + 4 + n]).decode(), at + 4 + n


def _records(data: memoryview):
    at = 0
    while at + 9 <= len(data):
        op, n = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        yield op, data[at + 9 : at + 9 + n]
        at += 9 + n


def _unpack(kind: str, data: memoryview, size: int) -> memoryview:
    if not kind:
        return data
    if kind == "zstd":
        import zstandard

        return memoryview(zstandard.ZstdDecompressor().decompress(bytes(data), max_output_size=size))
    if kind == "lz4":
        import lz4.frame

        return memoryview(lz4.frame.decompress(bytes(data)))
    raise ValueError(f"unknown compression {kind}")


class Names:
    """Schemas and channels met so far."""

    def __init__(self) -> None:
        self.schemas: dict[int, str] = {}
        self.channels: dict[int, tuple[str, str, str]] = {}

    def learn(self, op: int, body) -> None:
        if op == SCHEMA_OP:
            self.schemas[struct.unpack_from("<H", body)[0]] = _text(body, 2)[0]
        elif op == CHANNEL_OP:
            ident, schema = struct.unpack_from("<HH", body)
            topic, at = _text(body, 4)
            self.channels[ident] = (topic, _text(body, at)[0], self.schemas.get(schema, ""))


def chunk_index(path: str) -> tuple[list[tuple[int, int, int, int]], Names]:
    """(first log time, last, offset, length) of each chunk, and the names of the summary; no chunks without an index."""
    names, chunks = Names(), []
    with open_file(path) as f:
        size = f.size()
        f.seek(0)
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} isn't an MCAP file")
        if size < 8 + 29 + 8:
            return [], names
        f.seek(size - 8 - 29)
        tail = f.read(29)
        if tail[0] != FOOTER_OP or not (start := struct.unpack_from("<Q", tail, 9)[0]):
            return [], names
        f.seek(start)
        for op, body in _records(memoryview(f.read(size - 8 - 29 - start))):
            names.learn(op, body)
            if op == CHUNK_INDEX_OP:
                chunks.append(struct.unpack_from("<QQQQ", body))
    return sorted(chunks, key=lambda c: c[2]), names


class Wanted:
    """Topics and half-open time bounds; None: all."""

    def __init__(self, topics: set[str] | None = None, start: int | None = None, end: int | None = None):
        self.topics, self.start, self.end = topics, start, end

    def takes(self, topic: str, log: int) -> bool:
        return (self.topics is None or topic in self.topics) and (self.start is None or log >= self.start) and (self.end is None or log < self.end)

    def meets(self, low: int, high: int) -> bool:
        """May a chunk of these first and last times hold a wanted message?  Empty chunks say 0 and 0."""
        return high == 0 or ((self.start is None or high >= self.start) and (self.end is None or low < self.end))


def _message(path: str, seq: int, body, names: Names, wanted: Wanted):
    ident, _, log, publish = struct.unpack_from("<HIQQ", body)
    topic, encoding, schema = names.channels[ident]
    return (path, seq, topic, schema, encoding, log, publish, bytes(body[22:])) if wanted.takes(topic, log) else None


def _chunk(path: str, offset: int, body, names: Names, wanted: Wanted):
    low, high, size, _ = struct.unpack_from("<QQQI", body)
    kind, at = _text(body, 28)
    if not wanted.meets(low, high):
        return
    seq = offset * PER_CHUNK
    for op, part in _records(_unpack(kind, body[at + 8 :], size)):
        names.learn(op, part)
        if op == MESSAGE_OP:
            if (row := _message(path, seq, part, names, wanted)) is not None:
                yield row
            seq += 1


def messages(path: str, wanted: Wanted, chunks: list[tuple[int, int]] | None = None, names: Names | None = None):
    """Messages of a file in its order: of some chunks (offset, length), or all; one record or chunk is held at a time."""
    names = names or Names()
    with open_file(path) as f:
        if chunks is not None:
            for offset, length in chunks:
                f.seek(offset)
                yield from _chunk(path, offset, memoryview(f.read(length))[9:], names, wanted)
            return
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} isn't an MCAP file")
        at = 8
        while len(head := f.read(9)) == 9 and head[0] != DATA_END_OP:
            op, n = head[0], struct.unpack_from("<Q", head, 1)[0]
            body = memoryview(f.read(n))
            if len(body) < n:
                raise ValueError(f"{path} ends within a record")
            names.learn(op, body)
            if op == CHUNK_OP:
                yield from _chunk(path, at, body, names, wanted)
            elif op == MESSAGE_OP and (row := _message(path, at * PER_CHUNK, body, names, wanted)) is not None:
                yield row
            at += 9 + n


class _Part(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int]] | None, names: Names | None):
        self.path, self.chunks, self.names = path, chunks, names


class McapReader(DataSourceReader):
    def __init__(self, path: str, required: bool, wanted: Wanted):
        self.path, self.required, self.wanted = path, required, wanted

    def partitions(self):
        found = files(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        out = []
        for path in found:
            index, names = chunk_index(path)
            if not index:
                if self.required:
                    raise ValueError(f"{path} has no chunk index")
                out.append(_Part(path, None, None))
                continue
            held, size = [], 0
            for low, high, offset, length in index:
                if not self.wanted.meets(low, high):
                    continue
                held.append((offset, length))
                size += length
                if size >= PARTITION_BYTES:
                    out.append(_Part(path, held, names))
                    held, size = [], 0
            if held:
                out.append(_Part(path, held, names))
        return out or [_Part(found[0], [], None)]

    def read(self, partition):
        names = SCHEMA.replace(",", "").split()[::2]
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
        for row in messages(partition.path, self.wanted, partition.chunks, partition.names):
            rows.append(row)
            size += len(row[-1]) + 64
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class McapSource(DataSource):
    @classmethod
    def name(cls):
        return "mcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        number = lambda name: int(o[name]) if o.get(name) else None
        wanted = Wanted(set(json.loads(o["topics"])) if o.get("topics") else None, number("start_ns"), number("end_ns"))
        return McapReader(o["path"].removeprefix("file://").removeprefix("file:"), o.get("chunk_index") == "required", wanted)


def register(spark: SparkSession) -> None:
    """Makes format("mcap") known to the session."""
    spark.dataSource.register(McapSource)


def window(spark: SparkSession, path: str, topics: list[str] | None = None, start: int | None = None, end: int | None = None, required: bool = False) -> DataFrame:
    """Messages of some topics in [start, end) below a path; required: files must have a chunk index."""
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")
    register(spark)
    given = {"topics": json.dumps(topics) if topics is not None else None, "start_ns": start, "end_ns": end, "chunk_index": "required" if required else None}
    return spark.read.format("mcap").options(**{k: str(v) for k, v in given.items() if v is not None}).load(path)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(source, start_ns, end_ns, chunks) of the files below a path, from their indexes alone; nulls and 0 for files without one."""
    found = spark.createDataFrame([(p,) for p in files(path)], "source string")

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.column("source").to_pylist():
                index = [c for c in chunk_index(p)[0] if c[1]]
                rows.append((p, min((c[0] for c in index), default=None), max((c[1] for c in index), default=None), len(index)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["source", "start_ns", "end_ns", "chunks"]) if rows else batch.slice(0, 0)

    return found.mapInArrow(run, "source string, start_ns long, end_ns long, chunks long")


def image_time_range(found: DataFrame) -> DataFrame:
    """(source, first_ns, last_ns, topics) of image messages, told by schema or topic name; publish times, log times where these are 0."""
    is_image = F.col("schema_name").contains("Image") | F.lower("topic").contains("image")
    time = F.when(F.col("publish_ns") > 0, F.col("publish_ns")).otherwise(F.col("log_ns"))
    return found.where(is_image).groupBy("source").agg(F.min(time).alias("first_ns"), F.max(time).alias("last_ns"), F.array_sort(F.collect_set("topic")).alias("topics"))
