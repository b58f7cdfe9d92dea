"""The 64-byte window log as a Spark data source, batch and stream, and its writer.

Use: spark.dataSource.register(WindowLog); spark.read.format("windowlog").load(path) and
df.write.format("windowlog").mode("append").save(path). A path is a directory of log files or one file.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The record's fields in order, little endian, 64 bytes.
RECORD = struct.Struct("<QQQIIfffffHHHHI")
FIELDS = ["id", "window_start", "window_end", "byte_start", "byte_end", "coherence", "stability", "entropy", "rupture", "lambda_hazard", "sig_c", "sig_s", "sig_e", "flags", "reserved"]
LAYOUT = np.dtype({"names": FIELDS, "formats": ["<u8"] * 3 + ["<u4"] * 2 + ["<f4"] * 5 + ["<u2"] * 4 + ["<u4"]})
SCHEMA = "id bigint, window_start bigint, window_end bigint, byte_start bigint, byte_end bigint, coherence float, stability float, entropy float, rupture float, lambda_hazard float, sig_c int, sig_s int, sig_e int, flags int, reserved bigint"
TYPES = [pa.int64()] * 5 + [pa.float32()] * 5 + [pa.int32()] * 4 + [pa.int64()]
#: Records of one partition.
SPLIT = 1 << 20


def pack(row: dict) -> bytes:
    return RECORD.pack(*(row.get(f) or 0 for f in FIELDS))


def unpack(data: bytes) -> np.ndarray:
    """Whole records of the bytes; a torn last record is left out."""
    n = len(data) // LAYOUT.itemsize
    return np.frombuffer(data, LAYOUT, n)


def _batch(records: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records[f].astype(t.to_pandas_dtype()), t) for f, t in zip(FIELDS, TYPES, strict=True)], FIELDS)


def _files(path: str) -> list[str]:
    p = Path(path)
    return sorted(str(x) for x in (p.rglob("*.log") if p.is_dir() else [p]))


class Part(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def _read(part: Part) -> Iterator[pa.RecordBatch]:
    with open(part.path, "rb") as f:
        f.seek(part.first * LAYOUT.itemsize)
        left = part.count
        while left > 0:
            n = min(left, 65_536)
            got = unpack(f.read(n * LAYOUT.itemsize))
            if not len(got):
                return
            left -= len(got)
            yield _batch(got)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        out = []
        for f in _files(self.path):
            n = os.path.getsize(f) // LAYOUT.itemsize
            out += [Part(f, i, min(SPLIT, n - i)) for i in range(0, n, SPLIT)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _read(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the number of whole records of each file; nothing is emitted twice."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: os.path.getsize(f) // LAYOUT.itemsize for f in _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for f, n in end.items():
            at = start.get(f, 0)
            out += [Part(f, i, min(SPLIT, n - i)) for i in range(at, n, SPLIT)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


class Written(WriterCommitMessage):
    def __init__(self, temporary: str):
        self.temporary = temporary


class Writer(DataSourceWriter):
    """Each task writes a file of its own; a commit gives it its name, so failed tasks leave nothing to read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/{uuid.uuid4().hex}.part"
        with open(name, "wb") as f:
            for r in rows:
                f.write(pack(r.asDict()))
        return Written(name)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in _files(self.path):
                os.remove(f)
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.temporary.removesuffix(".part") + ".log")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class WindowLog(DataSource):
    """Fixed-width window records. Unsigned 64-bit values above the signed range wrap, as the type is bigint."""

    @classmethod
    def name(cls) -> str:
        return "windowlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
