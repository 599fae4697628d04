"""Reading parts of large files in tasks, and writing files from rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Bytes of blocks for a task, whose start costs as much as some megabytes, and tasks for a slot.
TASK_BYTES = 16 * 1024 * 1024
SLOT_TASKS = 4

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(.*)", re.DOTALL)


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI as Spark gives it, names unquoted, and the path within."""
    local = re.match(r"file:/+", path)
    if local or path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path if not local else "/" + path[local.end() :]
    parts = _URI.fullmatch(path)
    if not parts:
        raise ValueError(f"neither a path from the root nor a URI: {path}")
    system, root = pyarrow.fs.FileSystem.from_uri(f"{parts[1]}://{parts[2]}")
    return system, root.rstrip("/") + parts[3]


def opened(path: str) -> pa.NativeFile:
    """A file open for reading at any place; nothing is read yet."""
    system, inner = located(path)
    return system.open_input_file(inner)


def listed_files(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """``path, modificationTime, length`` of all files below a directory, contents unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory).select("path", "modificationTime", "length")


def block_rows(files: DataFrame, block_bytes: int) -> DataFrame:
    """``path, length, block, begin, stop`` of the blocks of ``path, length``, where they are."""
    blocks = F.ceil(F.col("length") / F.lit(block_bytes))
    places = F.sequence(F.lit(0).cast("bigint"), blocks.cast("bigint") - 1)
    return (
        files.filter("length > 0")
        .select("path", "length", F.explode(places).alias("block"))
        .withColumn("begin", F.col("block") * F.lit(block_bytes))
        .withColumn("stop", F.least(F.col("begin") + F.lit(block_bytes), "length"))
    )


def blocks_of(
    files: DataFrame, block_bytes: int, most_tasks: int = 4096
) -> tuple[DataFrame, int]:
    """``path, length, block, begin, stop`` of the blocks of ``path, length``, and their tasks.

    A task has about ``TASK_BYTES`` of blocks, read one after another, but every slot has some.
    """
    blocks = F.ceil(F.col("length") / F.lit(block_bytes))
    count, size = files.agg(F.sum(blocks), F.sum("length")).first()
    slots = files.sparkSession.sparkContext.defaultParallelism
    wanted = max(SLOT_TASKS * slots, int(size or 0) // TASK_BYTES)
    tasks = min(most_tasks, int(count or 1), wanted)
    return block_rows(files, block_bytes).repartition(tasks, "path", "block"), tasks


def store_file(directory: str, name: str, content: bytes | memoryview | pa.Buffer) -> None:
    """Write a file below a directory, over one of that name."""
    system, folder = located(directory)
    path = f"{folder}/{name}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(content)


def store_files(files: DataFrame, directory: str) -> None:
    """Write ``name, content`` rows as files below a directory.

    A file is written whole by the task of its row and overwritten if the task runs again.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content")):
                store_file(directory, name, content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["files"])

    files.select("name", "content").mapInArrow(write, "files BIGINT").agg(F.sum("files")).collect()
