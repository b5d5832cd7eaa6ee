"""A Spark data source for Arrow IPC files of sites.

    spark.dataSource.register(ArrowIPC)
    spark.read.format("arrow_ipc").load(path)
    sites.write.format("arrow_ipc").option("compression", "lz4").mode("append").save(folder)

Where spark.sql.python.filterPushdown.enabled is true, option("pushdown", "true") takes comparisons of chr and position
into the reader.

Paths and URIs go through pyarrow's file systems (local, hdfs://, s3://, gs://), on the driver and in tasks. The driver
only lists files; a partition is a stripe of a file's record batches, a stripe for each STRIPE bytes.

A write puts hidden files beside the others and names them at commit; overwrite deletes the old files then, so a write
that fails leaves them as they were."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from cytolake.schema import SITE

ARROW = pa.schema([("chr", pa.string()), ("position", pa.int64()), ("strand", pa.bool_()), ("context", pa.bool_()), ("count_m", pa.int64()), ("count_total", pa.int64()), ("density", pa.float64())])
#: Bytes of a file that one partition reads, about.
STRIPE = 64 << 20


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path[5:]}")
    return pa.fs.LocalFileSystem(), path


def files(path: str) -> list[pa.fs.FileInfo]:
    """The Arrow files of a folder, a file, or those whose name matches a glob in the last part of the path."""
    fs, p = located(path)
    kind = fs.get_file_info(p).type
    if kind == pa.fs.FileType.File:
        return [fs.get_file_info(p)]
    folder, pattern = (p, "*.arrow") if kind == pa.fs.FileType.Directory else posixpath.split(p)
    found = [x for x in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if x.type == pa.fs.FileType.File and fnmatch(x.base_name, pattern) and not x.base_name.startswith(".")]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found, key=lambda x: x.path)


@dataclass
class Stripe(InputPartition):
    """Record batches number, number + of, number + 2 of, ... of a file."""

    path: str
    number: int
    of: int


def as_sites(b: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of sites; dictionaries and narrower types are widened."""
    return pa.RecordBatch.from_arrays([b.column(n).cast(ARROW.field(n).type) for n in ARROW.names], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def partitions(self) -> list[InputPartition]:
        out = []
        for f in files(self.path):
            of = max(1, -(-f.size // STRIPE))
            out += [Stripe(f.path, k, of) for k in range(of)]
        return out

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        ops = {"==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
        fs, _ = located(self.path)
        with fs.open_input_file(partition.path) as f:
            source = pa.ipc.open_file(f)
            for k in range(partition.number, source.num_record_batches, partition.of):
                b = as_sites(source.get_batch(k))
                for name, op, value in self.tests:
                    b = b.filter(ops[op](b.column(name), value))
                yield b


class FilteringReader(Reader):
    """Simple comparisons of chr and position are taken over: rows that fail them do not leave Python."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("chr",), ("position",)):
                self.tests.append((f.attribute[0], {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}[type(f)], f.value))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, codec: str | None, overwrite: bool):
        self.folder, self.codec, self.overwrite = folder, codec, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = located(self.folder)
        fs.create_dir(folder)
        path = posixpath.join(folder, f".{uuid.uuid4().hex}.part")
        with fs.open_output_stream(path, compression=None) as f, pa.ipc.new_file(f, ARROW, options=pa.ipc.IpcWriteOptions(compression=self.codec)) as w:
            for b in batches:
                w.write_batch(as_sites(b))
        return Written(path)

    def commit(self, messages) -> None:
        fs, folder = located(self.folder)
        old = [x.path for x in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if x.base_name.endswith(".arrow")] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m):
            fs.move(m.path, posixpath.join(folder, f"part-{uuid.uuid4().hex[:8]}-{k:05d}.arrow"))
        for path in old:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, _ = located(self.folder)
        for m in messages:
            if m and fs.get_file_info(m.path).type == pa.fs.FileType.File:
                fs.delete_file(m.path)


class ArrowIPC(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return SITE

    def reader(self, schema: StructType) -> Reader:
        return (FilteringReader if self.options.get("pushdown", "false") == "true" else Reader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        codec = self.options.get("compression", "none")
        if codec not in ("none", "lz4", "zstd"):
            raise ValueError(f"unknown compression {codec!r}")
        return Writer(self.options["path"], None if codec == "none" else codec, overwrite)
