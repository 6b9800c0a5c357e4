"""Avro container files as a Spark data source, read by ranges between sync markers (SRC-09).

    spark.dataSource.register(Avro)
    spark.read.format("tallywind_avro").load(path)
    df.write.format("tallywind_avro").mode("append").save(path)
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

from tallywind.sources.shared import place

# Fixed values of the format.
MAGIC = b"Obj\x01"
PLAIN = {"null": StringType(), "boolean": BooleanType(), "int": IntegerType(), "long": LongType(), "float": FloatType(), "double": DoubleType(), "bytes": BinaryType(), "string": StringType(), "enum": StringType(), "fixed": BinaryType()}
LOGICAL = {("int", "date"): DateType(), ("long", "timestamp-micros"): TimestampType(), ("long", "timestamp-millis"): TimestampType()}
#: Bytes of a range; rows of a batch; bytes of a block, roughly.
RANGE, BATCH, BLOCK = 64 << 20, 2000, 64 << 10


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("an Avro value runs past its block")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7


def _named(s, names: dict) -> dict:
    """A schema as an object, names replaced by what they were given for."""
    if isinstance(s, str):
        return names[s] if s in names else {"type": s}
    if isinstance(s, dict) and isinstance(s["type"], dict | list):
        return _named(s["type"], names)
    if isinstance(s, dict) and s["type"] in ("record", "enum", "fixed"):
        space = s.get("namespace") or names.get("")  # a nested type's is the outer one's
        names.setdefault("", space)
        names[s["name"]] = s
        names[f"{space}.{s['name']}" if space else s["name"]] = s
    return s if isinstance(s, dict) else {"type": "union", "of": s}


def spark_type(s, names: dict | None = None) -> DataType:
    """The Spark type of an Avro schema; unions are of one type and null."""
    names = {} if names is None else names
    s = _named(s, names)
    kind = s["type"]
    if kind == "union":
        rest = [x for x in s["of"] if x != "null"]
        if len(rest) != 1:
            raise ValueError(f"a union of {len(rest)} types is not supported")
        return spark_type(rest[0], names)
    if kind == "record":
        return StructType([StructField(f["name"], spark_type(f["type"], names)) for f in s["fields"]])
    if kind == "array":
        return ArrayType(spark_type(s["items"], names))
    if kind == "map":
        return MapType(StringType(), spark_type(s["values"], names))
    return LOGICAL.get((kind, s.get("logicalType")), PLAIN[kind])


def decoder(s, names: dict | None = None):
    """A function from a cursor to the next value."""
    names = {} if names is None else names
    s = _named(s, names)
    kind = s["type"]
    if kind == "union":
        each = [decoder(x, names) for x in s["of"]]
        return lambda c: each[c.number()](c)
    if kind == "record":
        fields = [(f["name"], decoder(f["type"], names)) for f in s["fields"]]
        return lambda c: {n: f(c) for n, f in fields}
    if kind in ("array", "map"):
        item = decoder(s["items" if kind == "array" else "values"], names)

        def many(c):
            out = []
            while n := c.number():
                if n < 0:  # the block's size follows
                    n = -n
                    c.number()
                for _ in range(n):
                    out.append(item(c) if kind == "array" else (c.take(c.number()).decode(), item(c)))
            return out

        return many
    if kind == "enum":
        return lambda c: s["symbols"][c.number()]
    if kind == "fixed":
        return lambda c: c.take(s["size"])
    if kind in ("int", "long"):
        return (lambda c: c.number() * 1000) if s.get("logicalType") == "timestamp-millis" else Cursor.number
    return {
        "null": lambda c: None, "boolean": lambda c: c.take(1) == b"\x01", "float": lambda c: struct.unpack("<f", c.take(4))[0], "double": lambda c: struct.unpack("<d", c.take(8))[0],
        "bytes": lambda c: c.take(c.number()), "string": lambda c: c.take(c.number()).decode(),
    }[kind]


def number(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def avro_type(t: DataType, path: str = "row") -> dict | str:
    """The Avro schema of a Spark type, any value of which may be null."""
    simple = {StringType: "string", LongType: "long", IntegerType: "int", DoubleType: "double", FloatType: "float", BooleanType: "boolean", BinaryType: "bytes"}
    if isinstance(t, StructType):
        return {"type": "record", "name": path, "fields": [{"name": f.name, "type": ["null", avro_type(f.dataType, f"{path}_{i}")], "default": None} for i, f in enumerate(t.fields)]}
    if isinstance(t, ArrayType):
        return {"type": "array", "items": ["null", avro_type(t.elementType, path + "_i")]}
    if isinstance(t, MapType) and isinstance(t.keyType, StringType):
        return {"type": "map", "values": ["null", avro_type(t.valueType, path + "_v")]}
    if isinstance(t, DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(t, TimestampType):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if type(t) in simple:
        return simple[type(t)]
    raise ValueError(f"{t.simpleString()} can't be written as Avro")


def encoder(t: DataType):
    """A function from a value, or none, to its bytes, the number of the union's branch first."""
    if isinstance(t, StructType):
        fields = [(f.name, encoder(f.dataType)) for f in t.fields]
        body = lambda v: b"".join(f(v[n]) for n, f in fields)
    elif isinstance(t, ArrayType):
        item = encoder(t.elementType)
        body = lambda v: (number(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    elif isinstance(t, MapType):
        key, item = encoder(StringType()), encoder(t.valueType)
        body = lambda v: (number(len(v)) + b"".join(key(k)[1:] + item(x) for k, x in v) if v else b"") + b"\x00"
    elif isinstance(t, StringType | BinaryType):
        def body(v):
            data = v.encode() if isinstance(v, str) else bytes(v)
            return number(len(data)) + data
    elif isinstance(t, BooleanType):
        body = lambda v: b"\x01" if v else b"\x00"
    elif isinstance(t, DoubleType | FloatType):
        form = "<d" if isinstance(t, DoubleType) else "<f"
        body = lambda v: struct.pack(form, v)
    elif isinstance(t, DateType):
        from datetime import date

        body = lambda v: number((v - date(1970, 1, 1)).days)
    elif isinstance(t, TimestampType):
        from datetime import UTC, datetime, timedelta

        body = lambda v: number((v.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1))
    else:
        body = number
    return lambda v: b"\x00" if v is None else b"\x02" + body(v)


def header(f) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync marker, where blocks begin) of an open file."""
    data = f.read(64 << 10)
    while True:
        try:
            c = Cursor(data)
            if c.take(4) != MAGIC:
                raise RuntimeError("not an Avro container file")
            meta = dict(decoder({"type": "map", "values": "bytes"})(c))
            return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), c.take(16), c.at
        except ValueError:
            more = f.read(len(data))
            if not more:
                raise RuntimeError("an Avro header is cut short") from None
            data += more


def blocks(f, size: int, marker: bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(rows, bytes) of the blocks whose marker, the one before them, begins in start to end."""
    at, tail = start, b""
    f.seek(start)
    while True:  # the first marker
        more = f.read(1 << 20)
        if not more:
            return
        found = (tail + more).find(marker)
        if found >= 0:
            at = at - len(tail) + found
            break
        at, tail = at + len(more), (tail + more)[-15:]
        if at - 15 >= end:
            return
    while at < end and at + 16 < size:
        f.seek(at + 16)
        c = Cursor(f.read(20))
        rows, length = c.number(), c.number()
        f.seek(at + 16 + c.at)
        data = f.read(length + 16)
        if len(data) < length + 16 or data[length:] != marker:
            raise RuntimeError(f"an Avro block at {at + 16} is cut short or damaged")
        yield rows, data[:length]
        at += 16 + c.at + length


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class AvroReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.range = schema, options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self):
        out = []
        for path, size in avro_files(self.path):
            out += [Range(path, at, min(at + self.range, size)) for at in range(0, size, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        system, _ = place(self.path)
        arrow = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as f:
            written, codec, marker, begin = header(f)
            if codec not in ("null", "deflate"):
                raise RuntimeError(f"the codec {codec} is not supported: {partition.path}")
            next_row, rows = decoder(written), []
            for n, data in blocks(f, f.size(), marker, max(partition.start, begin - 16), partition.end):
                c = Cursor(zlib.decompress(data, -15) if codec == "deflate" else data)
                for _ in range(n):
                    rows.append(next_row(c))
                    if len(rows) == BATCH:
                        yield batch(rows, arrow)
                        rows = []
            if rows:
                yield batch(rows, arrow)


def batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Fields by name: those that a file lacks are null, those that nobody asked for go."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def avro_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the .avro files below a folder; hidden ones are left out."""
    system, root = place(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((i.path, i.size) for i in below if i.type == fs.FileType.File and i.path.endswith(".avro") and not any(p[0] in "._" for p in i.path[len(root) :].split("/") if p))


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


class AvroWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; they get their names when all tasks are done."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.codec, self.overwrite = schema, options["path"], options.get("codec", "deflate"), overwrite
        self.block, self.job = int(options.get("blockbytes", BLOCK)), uuid.uuid4().hex[:12]
        avro_type(schema)
        if self.codec not in ("null", "deflate"):
            raise ValueError(f"the codec {self.codec} is not supported")

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.avro"
        hidden = f"_{name}-{uuid.uuid4().hex[:8]}"
        marker, encode = uuid.uuid4().bytes, encoder(self.schema)
        meta = {"avro.schema": json.dumps(avro_type(self.schema)).encode(), "avro.codec": self.codec.encode()}
        with system.open_output_stream(f"{root}/{hidden}") as f:
            f.write(MAGIC + number(len(meta)) + b"".join(number(len(k)) + k.encode() + number(len(v)) + v for k, v in meta.items()) + b"\x00" + marker)

            def flush(rows, data):
                if rows:
                    body = bytes(data)
                    if self.codec == "deflate":
                        z = zlib.compressobj(6, zlib.DEFLATED, -15)
                        body = z.compress(body) + z.flush()
                    f.write(number(rows) + number(len(body)) + body + marker)

            rows, data = 0, bytearray()
            for b in iterator:
                for row in b.to_pylist():
                    data += encode(row)[1:]  # the row itself is no union
                    rows += 1
                    if len(data) >= self.block:
                        flush(rows, data)
                        rows, data = 0, bytearray()
            flush(rows, data)
        return Written(hidden, name)

    def commit(self, messages):
        system, root = place(self.path)
        old = [p for p, _ in avro_files(self.path)] if self.overwrite and system.get_file_info(root).type != fs.FileType.NotFound else []
        for m in messages:
            system.move(f"{root}/{m.hidden}", f"{root}/{m.name}")
        for p in old:
            system.delete_file(p)

    def abort(self, messages):
        system, root = place(self.path)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            return
        for i in system.get_file_info(fs.FileSelector(root)):
            if i.base_name.startswith("_part-") and f"-{self.job}.avro" in i.base_name:  # those of killed tasks too
                system.delete_file(i.path)


class Avro(DataSource):
    """Options: path; rangebytes (of a reading task); codec (deflate or null) and blockbytes (of writing). The schema is the
    first file's; one that the caller gives is resolved by names: missing fields are null, whole numbers may widen."""

    @classmethod
    def name(cls):
        return "tallywind_avro"

    def schema(self):
        files = avro_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Avro file in {self.options['path']}")
        with place(self.options["path"])[0].open_input_file(files[0][0]) as f:
            return spark_type(header(f)[0])

    def reader(self, schema):
        return AvroReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return AvroWriter(schema, dict(self.options), overwrite)
