"""Reading and writing text reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from cytolake.config import compression, report_type
from cytolake.operators.context import aligned
from cytolake.operators.sites import FROM_REPORT, TO_REPORT, cast
from cytolake.schema import ReportType

# Spark's text readers open plain files, .gz, .bz2 and .zst. Where a path holds .xz, .lzma, .zip or .lz4 files, all of
# its files are unpacked by Python, a file to a task.


def _lines_of(path: str, raw: bytes) -> Iterator[str]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open(z.namelist()[0]) as f:  # the first member
            yield from io.TextIOWrapper(f, "utf-8")
    elif path.endswith(".lz4"):
        with pa.CompressedInputStream(pa.BufferReader(raw), "lz4") as f:
            yield from io.TextIOWrapper(io.BufferedReader(_Raw(f)), "utf-8")
    elif path.endswith((".xz", ".lzma")):
        import lzma

        with lzma.open(io.BytesIO(raw), "rt", encoding="utf-8") as f:
            yield from f
    elif path.endswith(".gz"):
        import gzip

        with gzip.open(io.BytesIO(raw), "rt", encoding="utf-8") as f:
            yield from f
    elif path.endswith(".bz2"):
        import bz2

        with bz2.open(io.BytesIO(raw), "rt", encoding="utf-8") as f:
            yield from f
    elif path.endswith(".zst"):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(raw) as f:
            yield from io.TextIOWrapper(f, "utf-8")
    else:
        yield from io.TextIOWrapper(io.BytesIO(raw), "utf-8")


class _Raw(io.RawIOBase):
    """An Arrow stream as a Python one."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.stream.read(len(b))
        b[: len(got)] = got
        return len(got)


def own_files(spark: SparkSession, path: str) -> bool:
    """Does the path (a file, folder or glob) hold files that Spark's text reader cannot unpack? Only names are read."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return not names.filter(F.col("path").rlike(r"\.(xz|lzma|zip|lz4)$")).isEmpty()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line of text files, compressed or not, each by the ending of its own name. Globs are Spark's."""
    if not own_files(spark, path):
        return spark.read.text(path)

    def lines(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                held = []
                for line in _lines_of(p, raw.as_py()):
                    held.append(line.rstrip("\r\n"))
                    if len(held) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "value string")


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a report with the format's own columns; no quoting. The header line of a BedGraph is left out."""
    r = report_type(kind)
    if not r.skip and not own_files(spark, path):
        return spark.read.schema(r.schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    lines = text_lines(spark, path)
    if r.skip:
        lines = lines.filter(~F.col("value").rlike("^(track|browser|#)"))
    parts = F.split("value", "\t")
    return lines.filter("value <> ''").select(*[parts[k].cast(f.dataType).alias(f.name) for k, f in enumerate(r.schema)])


def read_sites(spark: SparkSession, path: str, kind: str, context: DataFrame | None = None) -> DataFrame:
    """A report as sites. context (see operators.context) aligns them with a genome; formats without strand and
    context need it."""
    r = report_type(kind)
    if r.aligned and context is None:
        raise ValueError(f"{r.name} needs a genome to align with")
    sites = cast(FROM_REPORT[r.name](read_rows(spark, path, kind)))
    return aligned(sites, context) if context is not None else sites


def report_rows(sites: DataFrame, kind: str) -> DataFrame:
    """Sites as rows of a report, with exactly the format's columns."""
    r: ReportType = report_type(kind)
    rows = TO_REPORT[r.name](sites)
    if rows.columns != r.columns:
        raise ValueError(f"{r.name} rows have columns {rows.columns}")
    return rows


def _leveled(w: DataFrameWriter, codec: str, level: int) -> DataFrameWriter:
    """A writer with codec and level; of Spark's codecs, gzip has levels."""
    names = ["NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"]
    if codec == "gzip":
        w = w.option("zlib.compress.level", names[level])
    return w.option("compression", codec) if codec else w


def write_report(sites: DataFrame, path: str, kind: str, codec: str | None = None, level: int = 1) -> None:
    """A folder of tab-separated files without header, in order of chromosome and position. BedGraph files start with
    a track line. Codecs that Spark's writer lacks (zstd, xz, zip) are written by tasks of Python, a file each.
    level (0 to 9, zstd from 1) is of gzip, zstd, xz and zip."""
    if not 0 <= level <= 9:
        raise ValueError("levels go from 0 to 9")
    r, found = report_type(kind), compression(codec)
    rows = report_rows(sites, kind).orderBy("chr", r.position)
    if found in ("", "gzip", "bzip2", "lz4") and not r.skip:
        _leveled(rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", ""), found, level).csv(path)
        return
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.columns])
    lines = rows.select(line.alias("value"))
    if r.skip:

        def headed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(["track type=bedGraph"])], names=["value"])
            for b in batches:  # one schema: a column without nulls has another
                yield pa.RecordBatch.from_arrays(b.columns, names=["value"])

        lines = lines.mapInArrow(headed, "value string")
    if found in ("", "gzip", "bzip2", "lz4"):
        _leveled(lines.write.mode("overwrite"), found, level).text(path)
        return
    _write_packed(lines, path, found, level)


def _write_packed(lines: DataFrame, path: str, codec: str, level: int) -> None:
    """Each task packs its lines; Spark's own writer stores the bytes, so any file system and commit protocol serves.

    The result is a Parquet folder of (name, content); unpack() lays the files out on a local disk."""

    def pack(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.tsv"
        # a batch of lines at a time goes through the compressor; only the compressed file is held
        parts = ("".join(f"{v}\n" for v in b.column("value").to_pylist()).encode() for b in batches)
        out = io.BytesIO()
        if codec == "xz":
            import lzma

            with lzma.open(out, "wb", preset=level) as f:
                f.writelines(parts)
        elif codec == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z, z.open(name, "w") as f:
                for part in parts:
                    f.write(part)
        else:
            import zstandard

            packer = zstandard.ZstdCompressor(level=max(1, level)).compressobj()
            for part in parts:
                out.write(packer.compress(part))
            out.write(packer.flush())
        ending = {"xz": "xz", "zip": "zip"}.get(codec, "zst")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.{ending}"]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    lines.mapInArrow(pack, "name string, content binary").write.mode("overwrite").parquet(path)


def unpack(spark: SparkSession, path: str, folder: str) -> list[str]:
    """The files of a packed report, one after the other, on the driver's disk."""
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    for r in spark.read.parquet(path).toLocalIterator():
        out.append(os.path.join(folder, r["name"]))
        with open(out[-1], "wb") as f:
            f.write(r["content"])
    return sorted(out)


def scientific(value: Column) -> Column:
    """A number as text with an exponent."""
    return F.format_string("%e", value)
