"""Files as a sink and byte ranges of files as a source (Python data sources).

``namedfiles`` writes rows ``(file, content)`` to files of those names below a folder.
Tasks write parts below a staging folder of the job; the commit puts the parts of the
attempts that succeeded in place, a file that several tasks wrote being joined in
partition order.  So a file's rows may be range-partitioned over tasks, and a task
that runs twice adds nothing.  A file that exists is replaced.

``byteranges`` reads every file below a folder in ranges ``(path, offset, length)``.
A partition holds ranges of about ``partitionBytes``, so a file of any size is read by
many tasks, and no row holds more than ``rangeBytes``.

Paths are anything pyarrow opens (local, hdfs, s3, gcs).
"""

from __future__ import annotations

import io
import json
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 1 << 20
PARTITION_BYTES = 64 << 20
_PIECE = 1 << 20
_NAMES = 1000             # names in a line of a manifest


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path.rstrip("/")))


def checked(name: str | None) -> str:
    """A relative file name that stays inside its folder."""
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a file name below the folder: {name!r}")
    return name


@dataclass
class _Parts(WriterCommitMessage):
    partition: int
    manifest: str | None                  # staged file with the names (file, part) in the order written; none without files


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, root = open_path(self.path)
        stage = f"{root}/{self.staging}"
        fs.create_dir(stage, recursive=True)
        parts, out, at = [], None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                    if out is None or name != at:
                        if out is not None:
                            out.close()
                        parts.append((checked(name), uuid.uuid4().hex))
                        at, out = name, fs.open_output_stream(f"{stage}/{parts[-1][1]}", compression=None)
                    out.write(content or b"")
        finally:
            if out is not None:
                out.close()
        manifest = None
        if parts:       # the names stay beside the parts: a message does not grow with the files
            manifest = uuid.uuid4().hex
            with fs.open_output_stream(f"{stage}/{manifest}", compression=None) as names:
                for at in range(0, len(parts), _NAMES):
                    names.write((json.dumps(parts[at:at + _NAMES]) + "\n").encode())
        task = TaskContext.get()
        return _Parts(task.partitionId() if task else 0, manifest)

    def commit(self, messages):
        fs, root = open_path(self.path)
        stage = f"{root}/{self.staging}"
        files: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            if m.manifest:
                with fs.open_input_stream(f"{stage}/{m.manifest}", compression=None) as src:
                    for line in io.BufferedReader(src):
                        for name, part in json.loads(line):
                            files.setdefault(name, []).append(part)
        for name, parts in files.items():
            whole = parts[0]
            if len(parts) > 1:
                whole = uuid.uuid4().hex
                with fs.open_output_stream(f"{stage}/{whole}", compression=None) as out:
                    for part in parts:
                        with fs.open_input_stream(f"{stage}/{part}", compression=None) as src:
                            while piece := src.read(_PIECE):
                                out.write(piece)
            if "/" in name:
                fs.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            fs.move(f"{stage}/{whole}", f"{root}/{name}")
        self._clear(fs, stage)

    def abort(self, messages):
        fs, root = open_path(self.path)
        self._clear(fs, f"{root}/{self.staging}")

    @staticmethod
    def _clear(fs, stage):
        if fs.get_file_info(stage).type == pafs.FileType.Directory:
            fs.delete_dir(stage)


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "namedfiles"

    def schema(self):
        return "file string, content binary"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


@dataclass
class _Spans(InputPartition):
    spans: list[tuple[str, int, int]]     # (path, begin, end)


def spans_of(sizes: list[tuple[str, int]], range_bytes: int, partition_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Files cut into spans of whole ranges; a partition gets spans of ``partition_bytes`` in all, about."""
    step = max(1, partition_bytes // range_bytes) * range_bytes
    out, room = [], 0
    for path, size in sizes:
        for begin in range(0, size, step):
            end = min(begin + step, size)
            if not out or room < end - begin:
                out.append([])
                room = step
            out[-1].append((path, begin, end))
            room -= end - begin
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.step = int(options.get("rangeBytes", RANGE_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        fs, root = open_path(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            infos = [fs.get_file_info(root)]
        else:
            infos = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = re.compile(r"(^|/)[_.]")
        sizes = sorted((i.path, i.size) for i in infos if i.is_file and not hidden.search(i.path[len(root):]))
        return [_Spans(s) for s in spans_of(sizes, self.step, self.partition_bytes)] or [_Spans([])]

    def read(self, partition):
        fs, _ = open_path(self.path)
        for path, begin, end in partition.spans:
            with fs.open_input_file(path) as src:
                src.seek(begin)
                for at in range(begin, end, self.step):
                    data = src.read(min(self.step, end - at))
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())],
                                                     names=["path", "offset", "length", "content"])


class ByteRanges(DataSource):
    @classmethod
    def name(cls):
        return "byteranges"

    def schema(self):
        return "path string, offset long, length long, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows (file, content)``; rows of a file follow each other in partition order, then row order."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("file", F.col("content").cast("binary").alias("content")).write.format("namedfiles").mode("append").save(folder)


def read_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(path, offset, length, content)`` of all files below ``folder``; empty files have no rows."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byteranges").option("rangeBytes", range_bytes).option("partitionBytes", partition_bytes).load(folder)


def write_documents(lines: DataFrame, folder: str, file: Column, order: list[str], head: Column, foot: Column,
                    num_partitions: int | None = None) -> None:
    """One file per value of ``file``: ``head``, the column ``line`` of its rows in ``order``, ``foot``, a line each.

    ``head`` and ``foot`` may use the column ``file``.  Range partitioning spreads a big document over many tasks.
    """
    n = num_partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [f"__o{i}" for i in range(len(order))]
    body = lines.select(file.alias("file"), F.lit(1).alias("part"), *[F.col(c).alias(k) for c, k in zip(order, keys)], "line")
    names = body.select("file").distinct()
    none = [F.lit(None).cast(body.schema[k].dataType).alias(k) for k in keys]
    ends = [names.select("file", F.lit(p).alias("part"), *none, c.alias("line")) for p, c in ((0, head), (2, foot))]
    every = body.unionByName(ends[0]).unionByName(ends[1])
    placed = every.repartitionByRange(n, "file", "part", *keys).sortWithinPartitions("file", "part", *keys)
    write_files(placed.select("file", F.concat("line", F.lit("\n")).alias("content")), folder)
