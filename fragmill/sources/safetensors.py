"""Two data sources for containers of tensors: ``tensor_headers`` (a row per tensor) and ``byte_spans``
(a row per requested range), and a writer.

Headers and payload are separate formats, so that header queries never read payload. A span is read and
hashed by one task per (file, group of requests); several ranges of a file are read in offset order.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from fragmill.operators.checks import SegmentIntegrityError
from fragmill.sources.transport import PinnedRevision, Transport

MOST_HEADER = 1 << 26
HEADER_SCHEMA = "path string, name string, dtype string, shape array<long>, lo long, hi long, body_offset long, file_size long, header_sha256 string, metadata map<string,string>"
SPAN_SCHEMA = "path string, start long, stop long, sha256 string, content binary"


def parse_header(raw: bytes, file_size: int, path: str = "") -> tuple[dict, dict, int]:
    """(tensors, metadata, body offset) of the first bytes of a container; raises on a malformed one."""
    if len(raw) < 8:
        raise SegmentIntegrityError(f"{path}: no header")
    (n,) = struct.unpack("<Q", raw[:8])
    if n > MOST_HEADER or 8 + n > file_size:
        raise SegmentIntegrityError(f"{path}: header of {n} bytes")

    def once(pairs):
        names = [k for k, _ in pairs]
        if len(set(names)) < len(names):
            raise SegmentIntegrityError(f"{path}: repeated key")
        return dict(pairs)

    try:
        header = json.loads(raw[8 : 8 + n].decode("utf-8"), object_pairs_hook=once)
    except (ValueError, RecursionError) as e:
        if isinstance(e, SegmentIntegrityError):
            raise
        raise SegmentIntegrityError(f"{path}: header isn't JSON") from None
    if not isinstance(header, dict):
        raise SegmentIntegrityError(f"{path}: header isn't an object")
    metadata = header.pop("__metadata__", {})
    if not isinstance(metadata, dict):
        raise SegmentIntegrityError(f"{path}: metadata isn't an object")
    for name, t in header.items():
        fields = (t.get("dtype"), t.get("shape"), t.get("data_offsets")) if isinstance(t, dict) else (None, None, None)
        whole = all(isinstance(x, list) and all(type(i) is int and i >= 0 for i in x) for x in fields[1:])
        if not (isinstance(fields[0], str) and whole and len(fields[2]) == 2 and fields[2][0] <= fields[2][1] <= file_size - 8 - n):
            raise SegmentIntegrityError(f"{path}: bad entry {name!r}")
    return header, metadata, 8 + n


def read_header(path: str, transport: Transport | None = None) -> tuple[dict, dict, int, int, bytes]:
    t = transport or Transport()
    size = t.size(path)
    head = t.get_range(path, 0, min(8, size))
    (n,) = struct.unpack("<Q", head) if len(head) == 8 else (0,)
    if n > MOST_HEADER:
        raise SegmentIntegrityError(f"{path}: header of {n} bytes")
    raw = head + (t.get_range(path, 8, min(8 + n, size)) if n else b"")
    tensors, metadata, body = parse_header(raw, size, path)
    return tensors, metadata, body, size, raw[:body]


class _Files(InputPartition):
    def __init__(self, paths: list):
        self.paths = paths


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.group = int(options.get("filespertask", "16"))

    def partitions(self):
        return [_Files(self.paths[i : i + self.group]) for i in range(0, len(self.paths), self.group)] or [_Files([])]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.paths:
            tensors, metadata, body, size, raw = read_header(path)
            digest = hashlib.sha256(raw).hexdigest()
            for name, t in tensors.items():
                lo, hi = t["data_offsets"]
                yield path, name, t["dtype"], t["shape"], lo, hi, body, size, digest, {k: str(v) for k, v in metadata.items()}


class _PrunedHeaderReader(_HeaderReader):
    def pushFilters(self, filters):
        """Keeps the files that equalities of the path ask for; every other condition is Spark's."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("path",) else set(f.value) if isinstance(f, In) and f.attribute == ("path",) else None
            if wanted is None:
                yield f
            else:
                self.paths = [p for p in self.paths if p in wanted]


class TensorHeaders(DataSource):
    """options: paths (JSON list), filesPerTask, pushFilters (true where the session pushes filters to sources)."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PrunedHeaderReader if self.options.get("pushfilters") == "true" else _HeaderReader)(self.options)


class _SpanReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = json.loads(options["requests"])
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self):
        by_file: dict[str, list] = {}
        for path, start, stop in self.requests:
            by_file.setdefault(path, []).append((start, stop))
        return [_Files([(p, s)]) for p, spans in by_file.items() for s in [sorted(spans)]] or [_Files([])]

    def read(self, partition) -> Iterator[tuple]:
        transport = Transport()
        for path, spans in partition.paths:
            for start, stop in spans:
                raw = transport.get_range(path, start, stop)
                yield path, start, stop, hashlib.sha256(raw).hexdigest(), raw if self.content else None


class ByteSpans(DataSource):
    """options: requests (JSON list of [path, start, stop]), content (true: bytes, false: digests only)."""

    @classmethod
    def name(cls) -> str:
        return "byte_spans"

    def schema(self) -> str:
        return SPAN_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SpanReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TensorHeaders)
    spark.dataSource.register(ByteSpans)


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("tensor_headers").option("paths", json.dumps(paths)).option("pushFilters", push).load()


def spans(spark: SparkSession, requests: list, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("byte_spans").option("requests", json.dumps(requests)).option("content", str(content)).load()


def read_spans(requests: DataFrame, content: bool = True, **options) -> DataFrame:
    """The rows that byte_spans gives, for a table of requests (path, start, stop) of any size: dealt by file, read in
    offset order, with one Transport (its options: pace, retries, headers, commit) a task; a failed read is tried
    again there. commit: the revision that every remote answer must carry."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        given = dict(options)
        commit = given.pop("commit", None)
        transport = Transport(pinned=PinnedRevision(commit) if commit else None, **given)
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                raw = transport.get_range(path, start, stop)
                row = {"path": path, "start": start, "stop": stop, "sha256": hashlib.sha256(raw).hexdigest(), "content": raw if content else None}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))

    rows = requests.select("path", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    return rows.repartition("path").sortWithinPartitions("path", "start").mapInArrow(run, SPAN_SCHEMA)


def write_container(path: str, tensors: list[tuple[str, str, list[int], bytes]], metadata: dict | None = None) -> dict:
    """Writes tensors in the given order; header padded to 8 bytes; renamed into place when complete. Returns
    the size and the digests of file, header and tensors, taken in the same pass."""
    table, at = {"__metadata__": {k: str(v) for k, v in metadata.items()}} if metadata else {}, 0
    for name, dtype, shape, raw in tensors:
        table[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    head = json.dumps(table, separators=(",", ":")).encode()
    head += b" " * (-len(head) % 8)
    head = struct.pack("<Q", len(head)) + head
    whole, digests = hashlib.sha256(head), {}
    with open(f"{path}.part", "wb") as f:
        f.write(head)
        for name, _, _, raw in tensors:
            f.write(raw)
            whole.update(raw)
            digests[name] = hashlib.sha256(raw).hexdigest()
    os.replace(f"{path}.part", path)
    return {"sha256": whole.hexdigest(), "size": len(head) + at, "body_offset": len(head), "header_sha256": hashlib.sha256(head).hexdigest(), "tensors": digests}


def write_segments(tensors: DataFrame, folder: str, by: list[str], order: list[str], file: Column) -> DataFrame:
    """One container per group of rows (name, dtype, shape, content), in a folder that all executors share; a row per
    file with its digests. file: the name from the group's columns. Places are computed on rows without content, so
    that a group's bytes are only ever a stream of pieces."""
    from fragmill.operators.fetch import header_json, land
    from fragmill.operators.layout import running_offsets

    rows = tensors.withColumn("file", file).withColumn("size", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))
    laid = running_offsets(rows.drop("content"), ["file"], [*order, "name"]).withColumnsRenamed({"lo": "new_lo", "hi": "new_hi"})
    keys = rows.select(*by, "file").distinct()
    meta = F.to_json(F.create_map(*(x for c in by for x in (F.lit(c), F.col(c).cast("string")))))
    layouts = header_json(laid).join(keys.select("file", meta.alias("metadata")), "file")
    pieces = laid.select("file", "name", F.col("new_lo").alias("local_off"), "size", "sha256").join(rows.select("file", "name", "content"), ["file", "name"])
    return keys.join(land(pieces, layouts, folder), "file").select(*by, "file", "sha256", "size", "body_offset", "header_sha256")
