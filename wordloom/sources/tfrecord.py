"""TFRecord files of tf.train.Example messages, read and written.

read_records() reads them from any file system Spark knows. As a data source, format name
"tfrecord", they are read and written on paths that all machines see as folders; options:
path (a file, directory or glob), check, and default.<column>. The schema's columns name
features: bigint, float/double, string or binary, and arrays of them. A feature that a
record lacks is its default, else null, or an empty array. Framing and messages are read and
written here; nothing but the standard library and Arrow is needed.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, StringType, StructType


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc_table()


def masked_crc(data: bytes) -> int:
    """CRC-32C of data, rotated and shifted as the format asks."""
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(path: str, check: bool = False) -> Iterator[bytes]:
    """The records of a file; a broken tail is an error."""
    with open(path, "rb") as f:
        yield from frames_of(f, path, check)


def frames_of(f: BinaryIO, path: str, check: bool = False) -> Iterator[bytes]:
    """The records of an open file."""
    while head := f.read(12):
        if len(head) < 12:
            raise ValueError(f"{path} ends inside a record")
        n = struct.unpack("<Q", head[:8])[0]
        data, tail = f.read(n), f.read(4)
        if len(data) < n or len(tail) < 4:
            raise ValueError(f"{path} ends inside a record")
        if check and (masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0] or masked_crc(data) != struct.unpack("<I", tail)[0]):
            raise ValueError(f"{path} holds a damaged record")
        yield data


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            v, i = b[i : i + 8], i + 8
        yield tag >> 3, v


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse_example(data: bytes) -> dict[str, list]:
    """The features of one message, each a list of bytes, floats or integers."""
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            values: list = []
            for kind, lst in _fields(parts.get(2, b"")):
                for _, v in _fields(lst):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif isinstance(v, int):
                        values.append(_signed(v))
                    else:
                        i = 0
                        while i < len(v):
                            x, i = _varint(v, i)
                            values.append(_signed(x))
            out[parts[1].decode()] = values
    return out


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _part(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def make_example(features: dict[str, list]) -> bytes:
    """The message of features given as lists of bytes or strings, floats or integers."""
    entries = b""
    for name, values in features.items():
        if values and isinstance(values[0], (bytes, bytearray, str)):
            inner = _part(1, b"".join(_part(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        elif values and isinstance(values[0], float):
            inner = _part(2, _part(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            inner = _part(3, _part(1, b"".join(_number(int(v)) for v in values)))
        entries += _part(1, _part(1, name.encode()) + _part(2, inner))
    return _part(1, entries)


def _cast(text: str, kind: DataType) -> object:
    """An option's text as a value of a column's type."""
    if isinstance(kind, (FloatType, DoubleType)):
        return float(text)
    return text.encode() if isinstance(kind, BinaryType) else text if isinstance(kind, StringType) else int(text)


def row_of(data: bytes, schema: StructType, defaults: dict[str, object]) -> tuple:
    """A message's features as a row; those it lacks by their defaults."""
    got, row = parse_example(data), []
    for f in schema.fields:
        many = isinstance(f.dataType, ArrayType)
        kind = f.dataType.elementType if many else f.dataType
        v = got.get(f.name, [])
        if isinstance(kind, StringType):
            v = [x.decode("utf-8", "replace") for x in v]
        elif isinstance(kind, BinaryType):
            v = [bytearray(x) for x in v]
        elif isinstance(kind, (FloatType, DoubleType)):
            v = [float(x) for x in v]
        row.append((v or defaults.get(f.name, v)) if many else v[0] if v else defaults.get(f.name))
    return tuple(row)


def read_records(spark: SparkSession, path: str, schema: str, defaults: dict[str, object] | None = None, check: bool = False) -> DataFrame:
    """The records of the files of a path, on any file system Spark knows. Files come to the
    workers as bytes and are the unit of parallelism; one of more than 2 GB is an error."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord").load(path).select("path", "content")
    values = dict(defaults or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[tuple] = []
                for data in frames_of(io.BytesIO(content.as_py()), name.as_py(), check):
                    rows.append(row_of(data, kinds, values))
                    if len(rows) == 1000:
                        yield _batch(rows, arrow)
                        rows = []
                yield _batch(rows, arrow)

    return files.mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, "*.tfrecord")) if os.path.isdir(path) else glob.glob(path))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        wanted = {k.lower()[8:]: v for k, v in options.items() if k.lower().startswith("default.")}
        self.defaults = {f.name: _cast(wanted[f.name.lower()], f.dataType) for f in schema.fields if f.name.lower() in wanted}

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _paths(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _File):
            return
        for data in frames(partition.path, self.options.get("check", "false") == "true"):
            yield row_of(data, self.schema, self.defaults)


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file:")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        name = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.tfrecord")
        with open(name + ".tmp", "wb") as f:
            for r in rows:
                f.write(frame(make_example({k: v if isinstance(v, list) else [] if v is None else [v] for k, v in r.asDict().items()})))
        os.rename(name + ".tmp", name)
        return _Written()


class TFRecord(DataSource):
    """Register with spark.dataSource.register(TFRecord)."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        raise ValueError("give the schema: records carry none")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
