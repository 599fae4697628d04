"""Files below a directory, listed by tasks, hidden names included."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import scratch_path

from .ranges import block_rows, located, opened

_FOUND = "path STRING, folder BOOLEAN, modificationTime TIMESTAMP, length BIGINT"
_ROWS = 10_000
# Bytes of lines or contents that a task hands on at a time.
_BATCH_BYTES = 4 * 1024 * 1024
# Bytes of text files that a task reads, and tasks at most.
_TASK_BYTES = 16 * 1024 * 1024
_MOST_TASKS = 4096


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = located(path)
            prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
            found = system.get_file_info(pyarrow.fs.FileSelector(inner, recursive=False))
            for begun in range(0, len(found), _ROWS):
                some = found[begun : begun + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([prefix + f.path for f in some], pa.string()),
                        pa.array([f.type == pyarrow.fs.FileType.Directory for f in some]),
                        pa.array([f.mtime for f in some], pa.timestamp("us", "UTC")),
                        pa.array([f.size for f in some], pa.int64()),
                    ],
                    names=["path", "folder", "modificationTime", "length"],
                )


def list_tree(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length`` of all files, whatever their names begin with.

    Spark's own readers hide names that begin with ``_`` or ``.``. Each directory is listed by
    a task, level by level, and what is found is stored in the shared folder; the driver sees
    whether there are directories left. A missing directory is Spark's path-not-found error.
    """
    # Looks for the directory and reads nothing.
    spark.read.format("binaryFile").load(directory)
    # Without a file it still has the columns.
    files = spark.createDataFrame([], _FOUND)
    level = spark.createDataFrame([(directory.rstrip("/"),)], "path STRING")
    while True:
        path = scratch_path(spark, "listing")
        level.repartition(F.col("path")).mapInArrow(_listed, _FOUND).write.parquet(path)
        found = spark.read.schema(_FOUND).parquet(path)
        files = files.unionByName(found.filter("NOT folder"))
        level = found.filter("folder").select("path")
        if not recursive or not level.limit(1).count():
            return files.drop("folder")


def with_content(files: DataFrame) -> DataFrame:
    """``files`` (``path, modificationTime, length``) with their whole ``content``."""
    columns = ["path", "modificationTime", "length"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                with opened(path) as file:
                    content = file.read()
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*one.columns, pa.array([content], pa.binary())], names=[*columns, "content"]
                )

    return files.select(*columns).mapInArrow(
        run, "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    )


def text_lines(files: DataFrame, block_bytes: int = _TASK_BYTES) -> DataFrame:
    """``path, value`` of the lines of text files, as Spark's text reader cuts them.

    ``files``: ``path, length``. They come as they were listed, in few tasks, so they are dealt
    out by their bytes; a file beyond ``block_bytes`` is read by several tasks, each line by
    the one in whose block it begins. Blocks part at line feeds, alone or after a return.
    """

    def packed(path: str, lines: list[str]) -> pa.RecordBatch:
        paths = pa.array([path] * len(lines), pa.string())
        values = pa.array(lines, pa.string())
        return pa.RecordBatch.from_arrays([paths, values], names=["path", "value"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("path", "begin", "stop")]
            for path, begin, stop in zip(*columns):
                for data in _block_text(path, begin, stop):
                    yield packed(path, _lines(data))

    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = min(_MOST_TASKS, int(total) // block_bytes + 1)
    tasks = max(tasks, files.sparkSession.sparkContext.defaultParallelism)
    blocks = block_rows(files, block_bytes).repartition(tasks, "path", "block")
    return blocks.select("path", "begin", "stop").mapInArrow(run, "path STRING, value STRING")


def _block_text(path: str, begin: int, stop: int) -> Iterator[bytes]:
    """The lines that begin in a block, some at a time, without the line feeds between."""
    with opened(path) as file:
        at, rest = begin, b""
        if begin:
            # What stands before the first line feed belongs to an earlier block.
            at, found = begin - 1, False
            while at < stop - 1 and not found:
                data = file.read_at(min(_BATCH_BYTES, stop - 1 - at), at)
                cut = data.find(b"\n")
                found, at = cut >= 0, at + (cut + 1 if cut >= 0 else len(data))
            if not found:
                return
        while at < stop:
            data = file.read_at(min(_BATCH_BYTES, stop - at), at)
            if not data:
                break
            at += len(data)
            # A line break of two bytes must not be cut in two.
            whole, mark, rest = (rest + data).rpartition(b"\n")
            if mark:
                yield whole
        while rest and (data := file.read_at(_BATCH_BYTES, at)):
            line, mark, _ = data.partition(b"\n")
            at, rest = at + len(data), rest + line
            if mark:
                break
        if rest:
            yield rest


def _lines(data: bytes) -> list[str]:
    text = data.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    return lines[:-1] if data.endswith(b"\r") else lines
