"""BSON files of documents as a Python data source, and a writer for them.

A row is a document: the name of the collection member that it belongs to, and the document as JSON. Files are read side
by side, each by one task that holds one document at a time; documents of other names are left where they are read.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Types of BSON elements that are read.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, OBJECT_ID, BOOLEAN, DATE, NULL, INT32, TIMESTAMP, INT64 = 1, 2, 3, 4, 5, 7, 8, 9, 10, 16, 17, 18


def _value(kind: int, data: memoryview, at: int) -> tuple[object, int]:
    """The value of an element and where the next one begins."""
    if kind in (DOCUMENT, ARRAY):
        size = struct.unpack_from("<i", data, at)[0]
        own = decode(data[at : at + size])
        return (list(own.values()) if kind == ARRAY else own), at + size
    if kind == STRING:
        size = struct.unpack_from("<i", data, at)[0]
        return bytes(data[at + 4 : at + 3 + size]).decode("utf-8", "replace"), at + 4 + size
    if kind == BINARY:
        size = struct.unpack_from("<i", data, at)[0]
        return bytes(data[at + 5 : at + 5 + size]).hex(), at + 5 + size
    if kind == DATE:
        stamp = struct.unpack_from("<q", data, at)[0]
        return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=stamp)).isoformat(timespec="milliseconds") + "Z", at + 8
    if kind == OBJECT_ID:
        return bytes(data[at : at + 12]).hex(), at + 12
    if kind == NULL:
        return None, at
    form = {DOUBLE: "<d", BOOLEAN: "<?", INT32: "<i", INT64: "<q", TIMESTAMP: "<Q"}.get(kind)
    if form is None:
        raise ValueError(f"BSON type {kind} is not read")
    return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)


def decode(data: bytes | memoryview) -> dict:
    """One document; object ids, binary data and dates become text."""
    data, at, out = memoryview(data), 4, {}
    while data[at]:
        kind, end = data[at], at + 1
        while data[end]:
            end += 1
        name = bytes(data[at + 1 : end]).decode("utf-8", "replace")
        out[name], at = _value(kind, data, end + 1)
    return out


def encode(document: dict) -> bytes:
    """One document of text, numbers, truth values, lists and documents."""
    body = b""
    for name, value in document.items():
        key = name.encode() + b"\0"
        if value is None:
            body += bytes([NULL]) + key
        elif isinstance(value, bool):
            body += bytes([BOOLEAN]) + key + struct.pack("<?", value)
        elif isinstance(value, int):
            body += bytes([INT64]) + key + struct.pack("<q", value)
        elif isinstance(value, float):
            body += bytes([DOUBLE]) + key + struct.pack("<d", value)
        elif isinstance(value, str):
            text = value.encode() + b"\0"
            body += bytes([STRING]) + key + struct.pack("<i", len(text)) + text
        else:
            inner = dict(zip(map(str, range(len(value))), value, strict=True)) if isinstance(value, list) else value
            body += bytes([ARRAY if isinstance(value, list) else DOCUMENT]) + key + encode(inner)
    return struct.pack("<i", len(body) + 5) + body + b"\0"


class Bson(DataSource):
    """Options: path (a folder of .bson files that all tasks see), names (JSON list; all if absent), field (whose value is the
    name, "name" by default)."""

    @classmethod
    def name(cls) -> str:
        return "bson"

    def schema(self) -> str:
        return "name string, document string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.field = options["path"], options.get("field", "name")
        self.names = set(json.loads(options["names"])) if options.get("names") else None

    def partitions(self) -> list[_File]:
        system, path = fs.FileSystem.from_uri(self.path)
        return [_File(x.path) for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".bson")]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as f:
            while head := f.read(4):
                own = decode(head + f.read(struct.unpack("<i", head)[0] - 4))
                name = own.get(self.field)
                if self.names is None or name in self.names:
                    yield name, json.dumps({k: v for k, v in own.items() if k != "_id"}, ensure_ascii=False)


def write_bson(df: DataFrame, folder: str) -> int:
    """Rows as documents, a file for each task; how many were written. A task that runs again writes the same file anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        n, part, own = 0, f"part-{TaskContext.get().partitionId()}", uuid.uuid4().hex
        with system.open_output_stream(f"{path}/{own}.tmp") as f:
            for batch in batches:
                for row in batch.to_pylist():
                    f.write(encode(row))
                    n += 1
        system.move(f"{path}/{own}.tmp", f"{path}/{part}.bson")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sum(r["n"] for r in df.mapInArrow(run, "n long").collect())
