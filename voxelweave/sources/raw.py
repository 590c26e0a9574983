"""Headerless float32 records, and the tables that runs leave beside them.

`register(spark)` adds the formats "xyz32" (records of x, y, z) and "scalar32" (one value a record, such as
the errors of points), which read byte ranges of a file in parallel and write
one part file a task. A partial last record is dropped; offset and count must be multiples of the record;
count 0 or one beyond the end reads to the end; an offset beyond the end reads nothing. An append numbers its
parts after those that are there; an overwrite deletes those first. Null values are written as NaN.
Paths are URIs that pyarrow.fs can open, or plain local paths. Stores that only Spark reaches go
through `read_blobs`, one file a row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = 12
SPLIT = 64 << 20
ROWS = 1 << 18
POINT = "index long, x float, y float, z float"
AXES, VALUE = ("x", "y", "z"), ("value",)
PART = re.compile(r"part_rank(\d+)\.bin")

MANIFEST = "block_id long, input_offset long, input_size long, rank long, part_offset long, compressed_size long"
CELL_MANIFEST = "rank long, mode string, input_bytes long, input_blocks_owned long, owned_cells long, part_offset long, compressed_size long"
SUMMARY = (
    "nranks long, num_blocks long, block_size long, shared_codebook boolean, warmup_s double, input_bytes long, compressed_bytes long, ratio double, wall_max_s double, wall_min_s double, "
    "phase_max struct<read:double,comp:double,write:double>, end_to_end_throughput_GBps double, per_rank array<struct<rank:long,input_bytes:long,compressed_bytes:long,blocks:long,wall_s:double>>"
)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_size(path: str) -> int:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def byte_range(size: int, offset: int = 0, count: int = 0, record: int = RECORD) -> tuple[int, int]:
    """First and last byte of a range of whole records."""
    if offset % record or count % record or offset < 0 or count < 0:
        raise ValueError(f"offset and count must be multiples of {record}")
    end = size - size % record
    first = min(offset, end)
    return first, min(end, first + count) if count else end


def to_points(raw: bytes, first: int = 0, columns: tuple[str, ...] = AXES) -> pa.RecordBatch:
    width = len(columns)
    table = np.frombuffer(raw, "<f4", len(raw) // (4 * width) * width).reshape(-1, width)
    index = np.arange(first, first + len(table))
    return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(width)]], ["index", *columns])


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: tuple[str, ...]):
        self.options, self.columns, self.record = options, columns, 4 * len(columns)

    def partitions(self):
        path, split = self.options["path"], max(1, int(self.options.get("split", SPLIT)) // self.record) * self.record
        first, last = byte_range(file_size(path), int(self.options.get("offset", 0)), int(self.options.get("count", 0)), self.record)
        return [_Range(path, a, min(last, a + split)) for a in range(first, last, split)] or [_Range(path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            for a in range(partition.first, partition.last, ROWS * self.record):
                yield to_points(f.read_at(min(ROWS * self.record, partition.last - a), a), a // self.record, self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, part: str):
        self.part = part


class _Writer(DataSourceArrowWriter):
    """Each task writes a hidden file of its own; the commit names the parts in order of the tasks, so a retried task leaves no second copy."""

    def __init__(self, options: dict, overwrite: bool, columns: tuple[str, ...]):
        self.path, self.overwrite, self.columns, self.run = options["path"].rstrip("/"), overwrite, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        name = f"_part_{self.run}_{context.partitionId():06d}_{context.taskAttemptId()}"
        with fs.open_output_stream(f"{at}/{name}") as f:
            for b in iterator:
                columns = [b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False).astype("<f4") for c in self.columns]
                f.write(np.stack(columns, 1).tobytes())
        return _Written(name)

    def commit(self, messages) -> None:
        fs, at = _open(self.path)
        there = [(int(m[1]), f.path) for f in self._files(fs, at) if (m := PART.fullmatch(f.base_name))]
        if self.overwrite:
            for _, path in there:
                fs.delete_file(path)
            there = []
        rank = max((k for k, _ in there), default=-1) + 1
        for m in sorted((m.part for m in messages if m is not None)):
            fs.move(f"{at}/{m}", f"{at}/part_rank{rank:04d}.bin")
            rank += 1
        self._clear(fs, at)

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    def _files(self, fs, at: str) -> list[pafs.FileInfo]:
        return [f for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File]

    def _clear(self, fs, at: str) -> None:
        """Delete what attempts of this run have left that weren't taken."""
        for f in self._files(fs, at):
            if f.base_name.startswith(f"_part_{self.run}_"):
                fs.delete_file(f.path)


class Xyz32(DataSource):
    columns = AXES

    @classmethod
    def name(cls) -> str:
        return "xyz32"

    def schema(self) -> str:
        return ", ".join(["index long", *[f"{c} float" for c in self.columns]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self.columns)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, self.columns)


class Scalar32(Xyz32):
    columns = VALUE

    @classmethod
    def name(cls) -> str:
        return "scalar32"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Xyz32)
    spark.dataSource.register(Scalar32)


def read_points(spark: SparkSession, path: str, offset: int = 0, count: int = 0) -> DataFrame:
    """index, x, y, z of a file's records in a byte range."""
    register(spark)
    return spark.read.format("xyz32").options(offset=offset, count=count).load(path)


def write_points(df: DataFrame, path: str, mode: str = "append") -> None:
    """x, y, z as part files; mode: append or overwrite."""
    register(df.sparkSession)
    df.select(F.lit(0).cast("long").alias("index"), *[F.col(c).cast("float").alias(c) for c in AXES]).write.format("xyz32").mode(mode).save(path)


def read_scalars(spark: SparkSession, path: str, offset: int = 0, count: int = 0) -> DataFrame:
    """index, value of a file's records in a byte range."""
    register(spark)
    return spark.read.format("scalar32").options(offset=offset, count=count).load(path)


def read_blobs(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """path, length, content of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def blob_points(blobs: DataFrame) -> DataFrame:
    """index, x, y, z of the records of whole files, each file counted from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                yield to_points(raw.as_py())

    return blobs.select("content").mapInArrow(run, POINT)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """rank, path, length of the part files part_rankNNNN.bin in a folder, empty ones left out, by rank."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part_rank*.bin").load(path).select("path", "length")
    rank = F.regexp_extract("path", PART.pattern, 1)
    return found.filter((rank != "") & (F.col("length") > 0)).select(rank.cast("int").alias("rank"), "path", "length").orderBy("rank")


def write_scalars(df: DataFrame, column: str, path: str) -> None:
    """One column as part files of float32 values, such as the errors of points, in place of what was there."""
    register(df.sparkSession)
    df.select(F.lit(0).cast("long").alias("index"), F.col(column).cast("float").alias("value")).write.format("scalar32").mode("overwrite").save(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's one row as the JSON object `path`/summary.json."""
    fs, at = _open(path.rstrip("/"))
    row = summary.select(F.to_json(F.struct("*")).alias("json")).limit(1).collect()
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/summary.json") as f:
        f.write((row[0]["json"] if row else "{}").encode())


def read_manifest(spark: SparkSession, path: str, cells: bool = False) -> DataFrame:
    """Manifest rows (JSON lines) of a per-chunk run, or of a global one."""
    return spark.read.schema(CELL_MANIFEST if cells else MANIFEST).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_summaries(spark: SparkSession, root: str, base: str) -> DataFrame:
    """nodes, block_mib and the fields of each summary.json in folders <base>_n<N>/blk<M>M under root."""
    got = spark.read.schema(SUMMARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(root)
    at = F.regexp_extract(F.input_file_name(), rf"/{re.escape(base)}_n(\d+)/blk(\d+)M/", 1)
    size = F.regexp_extract(F.input_file_name(), rf"/{re.escape(base)}_n(\d+)/blk(\d+)M/", 2)
    return got.withColumn("nodes", F.nullif(at, F.lit("")).cast("int")).withColumn("block_mib", F.nullif(size, F.lit("")).cast("int")).filter("nodes is not null")
