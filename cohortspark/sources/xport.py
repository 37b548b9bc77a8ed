"""The SAS transport format (version 5) as a Spark data source: 80-byte records, hexadecimal doubles, split by rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

RECORD = 80
# Fixed values of the format.
_HEAD = b"HEADER RECORD*******%s HEADER RECORD!!!!!!!"
LIBRARY, MEMBER, DESCRIPTOR, NAMES, ROWS = (_HEAD % w for w in (b"LIBRARY", b"MEMBER ", b"DSCRPTR", b"NAMESTR", b"OBS    "))
_NAME = struct.Struct(">hhhh8s40s8shhh2s8shhi52s")  # kind, -, length, number, name, label, format .., place
MISSING = frozenset(b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Rows that one task reads at a time, and bytes that a partition has.
BATCH, SPLIT = 20_000, 64 << 20


@dataclass(frozen=True)
class Field:
    name: str
    text: bool
    at: int
    length: int


@dataclass(frozen=True)
class Member:
    """One table of a file: its fields, and the bytes in which its rows lie."""

    name: str
    fields: tuple[Field, ...]
    start: int
    end: int

    @property
    def width(self) -> int:
        return sum(f.length for f in self.fields)


def numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of hexadecimal doubles, one row of 2 to 8 bytes each: sign, power of 16 above 64, fraction."""
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, : raw.shape[1]] = raw
    missing = np.isin(whole[:, 0], list(MISSING)) & ~whole[:, 1:].any(axis=1)
    bits = whole.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(float)
    power = 4 * (((bits >> np.uint64(56)) & np.uint64(127)).astype(np.int32) - 64) - 56
    value = np.ldexp(fraction, power)
    return np.where(bits >> np.uint64(63) == 1, -value, value), missing


def hexadecimal(value: float | None) -> bytes:
    """A double in 8 bytes; None is the missing value ".". Sizes beyond the format's 16^63 are an error, below 16^-65 zero."""
    if value is None or value != value:
        return b"." + bytes(7)
    if value == 0:
        return bytes(8)
    fraction, power = np.frexp(abs(value))
    power = int(power)
    up = -(-power // 4)
    mantissa = int(float(fraction) * (1 << 53)) << 3 >> (4 * up - power)
    if up + 64 > 127:
        raise ValueError(f"{value} is too large for a transport file")
    return ((int(value < 0) << 63) | (up + 64) << 56 | mantissa).to_bytes(8, "big") if up + 64 >= 0 else bytes(8)


def _open(path: str):
    if path.startswith("file:"):
        path = path[5:].replace("///", "/", 1)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The transport files of a path: itself, or all of a folder, by name."""
    system, name = _open(path)
    info = system.get_file_info(name)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    return sorted(prefix + i.path for i in system.get_file_info(pafs.FileSelector(name)) if i.type == pafs.FileType.File and i.path.lower().endswith(".xpt"))


def members(path: str) -> list[Member]:
    """The tables of a file. Only headers are kept; rows are passed over in chunks to find where the next table begins."""
    system, name = _open(path)
    out: list[Member] = []
    with system.open_input_file(name) as f:
        size = f.size()
        if not f.read(RECORD).startswith(LIBRARY):
            raise ValueError(f"{path} is no transport file")
        at = 3 * RECORD
        while at + RECORD <= size:
            f.seek(at)
            head = f.read(4 * RECORD)
            if not head.startswith(MEMBER):
                raise ValueError(f"{path}: no table at byte {at}")
            length = int(head[74:78])
            table = head[2 * RECORD + 8 : 2 * RECORD + 16].decode("latin-1").strip()
            f.seek(at + 4 * RECORD)
            names = f.read(RECORD)
            count = int(names[54:58])
            begin = at + 5 * RECORD + -(-count * length // RECORD) * RECORD
            raw = f.read(count * length)
            fields = []
            for i in range(count):
                kind, _, n, _, field_, *rest = _NAME.unpack(raw[i * length : i * length + _NAME.size])
                fields.append(Field(field_.decode("latin-1").strip(), kind == 2, rest[-2], n))
            begin += RECORD  # the header of the rows
            end = _next(f, begin, size)
            out.append(Member(table, tuple(fields), begin, end))
            at = end
    return out


def _next(f, begin: int, size: int) -> int:
    at, step = begin, RECORD * 100_000
    while at < size:
        f.seek(at)
        chunk, found = f.read(step), -1
        while (found := chunk.find(MEMBER, found + 1)) >= 0:
            if found % RECORD == 0:
                return at + found
        at += step
    return size


def _rows(f, m: Member) -> int:
    """How many rows a table has: blank ones at the end, less than a record of them, are filling."""
    n = (m.end - m.start) // m.width
    first = max(0, n - -(-RECORD // m.width))
    f.seek(m.start + first * m.width)
    tail = f.read((n - first) * m.width)
    while n > first and not tail[(n - 1 - first) * m.width : (n - first) * m.width].strip(b" "):
        n -= 1
    return n


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, member: str | None, schema: StructType):
        self.path, self.member, self.schema = path, member, schema

    def partitions(self) -> list[_Range]:
        out = []
        for path in files(self.path):
            system, name = _open(path)
            for m in _chosen(path, self.member):
                with system.open_input_file(name) as f:
                    n, each = _rows(f, m), max(1, SPLIT // m.width)
                out += [_Range(path, at, min(each, n - at)) for at in range(0, n, each)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        m = _chosen(part.path, self.member)[0]
        own = {f.name: f for f in m.fields}
        system, name = _open(part.path)
        with system.open_input_file(name) as f:
            for at in range(part.start, part.start + part.rows, BATCH):
                n = min(BATCH, part.start + part.rows - at)
                f.seek(m.start + at * m.width)
                table = np.frombuffer(f.read(n * m.width), np.uint8).reshape(n, m.width)
                columns = []
                for c in self.schema.fields:
                    x = own.get(c.name)
                    if x is None:
                        columns.append(pa.nulls(n, pa.string() if c.dataType == StringType() else pa.float64()))
                    elif x.text:
                        cells = [bytes(r).decode("latin-1").rstrip(" ") for r in table[:, x.at : x.at + x.length]]
                        columns.append(pa.array([v or None for v in cells], pa.string()))
                    else:
                        value, missing = numbers(table[:, x.at : x.at + x.length])
                        columns.append(pa.array(value, pa.float64(), mask=missing))
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


def _chosen(path: str, member: str | None) -> list[Member]:
    found = [m for m in members(path) if member is None or m.name == member]
    if not found:
        raise ValueError(f"{path} has no table {member}")
    return found[:1]


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a transport file of its own rows; numbers take 8 bytes, texts as many as given by ``width``."""

    def __init__(self, path: str, schema: StructType, width: int):
        self.path, self.schema, self.width = path, schema, width

    def write(self, rows: Iterator) -> _Written:
        system, name = _open(self.path)
        system.create_dir(name, recursive=True)
        target = f"{name}/part-{uuid.uuid4().hex}.xpt"
        fields, at = [], 0
        for i, c in enumerate(self.schema.fields):
            text = c.dataType == StringType()
            length = self.width if text else 8
            fields.append(_NAME.pack(2 if text else 1, 0, length, i + 1, c.name.encode("latin-1")[:8].ljust(8), b" " * 40, b" " * 8, 0, 0, 0, b"  ", b" " * 8, 0, 0, at, bytes(52)))
            at += length
        stamp = b"01JAN26:00:00:00"
        with system.open_output_stream(target) as f:
            f.write(LIBRARY + b"0" * 30 + b"  " + b"SAS     SAS     SASLIB  9.4     LINUX   ".ljust(64) + stamp + stamp.ljust(80))
            f.write(MEMBER + b"000000000000000001600000000140  " + DESCRIPTOR + b"0" * 30 + b"  ")
            f.write(b"SAS     TABLE   SASDATA 9.4     LINUX   ".ljust(64) + stamp + stamp.ljust(80) + NAMES + b"000000%04d00000000000000000000  " % len(fields))
            block = b"".join(fields)
            f.write(block + b" " * (-len(block) % RECORD) + ROWS + b"0" * 30 + b"  ")
            size = 0
            for row in rows:
                cells = [(v or "").encode("latin-1")[: self.width].ljust(self.width) if c.dataType == StringType() else hexadecimal(None if v is None else float(v)) for c, v in zip(self.schema.fields, row)]
                size += f.write(b"".join(cells)) or at
            f.write(b" " * (-size % RECORD))
        return _Written(target)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                system, _ = _open(self.path)
                system.delete_file(m.name)


class Xport(DataSource):
    """Options: ``path``, a file or a folder of ``.xpt``; ``member``, the table to read (the first); ``width`` of written texts."""

    @classmethod
    def name(cls) -> str:
        return "xport"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no transport files in {self.options['path']}")
        fields = _chosen(found[0], self.options.get("member"))[0].fields
        return StructType([StructField(f.name, StringType() if f.text else DoubleType()) for f in fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("member"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, int(self.options.get("width", 16)))


def read_cycles(spark: SparkSession, folder: str, component: str, cycles: list[str]) -> DataFrame:
    """A survey component over its cycles: ``<component>_<cycle>.xpt`` with the cycle's letter; missing files are passed over.

    Zeros that the format stores as a number below 1e-70 become 0. Without any file the frame is empty.
    """
    spark.dataSource.register(Xport)
    out = None
    for cycle in cycles:
        try:
            path = files(f"{folder}/{component}_{cycle}.xpt")[0]
        except FileNotFoundError:
            continue
        df = spark.read.format("xport").option("path", path).load()
        df = df.select(*[F.when(F.abs(c) < 1e-70, 0.0).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes], F.lit(cycle).alias("cycle"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "SEQN long, cycle string")
    return out.withColumn("SEQN", F.col("SEQN").cast("long"))
