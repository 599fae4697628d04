"""File discovery, media routing and upload checks on ``binaryFile`` rows.

All functions take rows with at least ``path``; columns such as ``content`` are only read
when a later step selects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.strings import as_column
from folioflow.schemas import LABELS

# Extension sets and content types.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".m4v")
PDF_CONTENT_TYPE = "application/pdf"
IMAGE_CONTENT_TYPES = ("image/jpeg", "image/png", "image/jpg")
FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# Tasks for each partition of a scan that is evened out.
SPREAD = 8
# Largest value of a binary column.
MAX_CONTENT_BYTES = 2_147_483_647 - 64


def read_files(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """All files below a directory as ``path, modificationTime, length, content``.

    Spark hides empty files and names that begin with ``_`` or ``.``; ``listing.list_tree`` has
    them too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory)


def stream_files(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """The same columns as a stream of the files that arrive below a directory."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory)


def spread_tasks(scan: DataFrame) -> int:
    """Over how many tasks costly work on the rows of a plain file scan should spread.

    At least one for each task slot, and several for each partition of the scan, so that they
    grow in number with the input and not in length.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return max(slots, scan.rdd.getNumPartitions() * SPREAD)


def spread_scan(scan: DataFrame) -> DataFrame:
    """Even out a scan that yields fewer partitions than there are task slots.

    For costly per-row work on a few files that cannot be split; with enough partitions, or on
    a stream, the scan is returned as it is. ``scan`` must be a plain file scan, since its
    partitions are counted; see ``spread_tasks``.
    """
    if scan.isStreaming:
        return scan
    slots = scan.sparkSession.sparkContext.defaultParallelism
    few = scan.rdd.getNumPartitions() < slots
    return scan.repartition(spread_tasks(scan)) if few else scan


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot, empty for names like ``.profile`` or ``notes``."""
    return F.lower(F.regexp_extract(as_column(path), r"(?:^|/)\.*[^./][^/]*(\.[^./]*)$", 1))


def media_kind(path: Column | str) -> Column:
    """``image`` or ``video`` by extension, null for anything else, PDF included."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(
        ext.isin(*VIDEO_EXTENSIONS), "video"
    )


def discover(files: DataFrame) -> DataFrame:
    """Processable files with ``kind`` and their order key ``directory, name``."""
    return (
        files.withColumn("kind", media_kind("path"))
        .filter(F.col("kind").isNotNull())
        .withColumn("directory", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        .withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    )


def route_media(uploads: DataFrame, path: str = "path", content_type: str = "content_type"):
    """Add ``kind``: the content type decides, else a .pdf name, else an image is tried."""
    declared = F.col(content_type)
    return uploads.withColumn(
        "kind",
        F.when(declared == PDF_CONTENT_TYPE, "pdf")
        .when(declared.isin(*IMAGE_CONTENT_TYPES), "image")
        .when(F.lower(path).endswith(".pdf"), "pdf")
        .otherwise("image"),
    )


def check_archives(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted archive uploads, and rejected ones with a ``reason``.

    Archives given by their path may have any size; only one whose ``content`` is a column must
    fit a binary value.
    """
    too_large = (
        F.col("length") > MAX_CONTENT_BYTES if "content" in uploads.columns else F.lit(False)
    )
    reason = (
        F.when(
            ~F.coalesce(F.lower("path").endswith(".zip"), F.lit(False)),
            "not_zip",
        )
        .when(F.col("length") == 0, "empty")
        .when(too_large, "too_large")
    )
    checked = uploads.withColumn("reason", reason)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from a CSV file with a header, columns by name and in any order.

    Columns the file lacks are null. ``malformed`` lists the columns whose value is there but
    cannot be read; such a value is null, and still is a truth that was not met.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    fields = T.StructType.fromDDL(LABELS).fields
    given = {f.name: F.col(f.name) if f.name in raw.columns else F.lit(None) for f in fields}
    read = [given[f.name].cast("string").try_cast(f.dataType).alias(f.name) for f in fields]
    unread = [
        F.when(
            given[f.name].isNotNull() & given[f.name].cast("string").try_cast(f.dataType).isNull(),
            f.name,
        )
        for f in fields
    ]
    return raw.select(*read, F.array_compact(F.array(*unread)).alias("malformed"))
