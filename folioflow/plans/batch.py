"""Batches of images, video frames and archive members through a per-document function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.documents import Task, document_id, map_documents, spread_documents
from folioflow.operators.reports import NO_MEMBERS, batch_report
from folioflow.operators.sampling import MAX_FRAMES_IN_BATCH, sample_media
from folioflow.sources.archives import expand_archive_files, expand_archives
from folioflow.sources.files import check_archives, discover

KEPT = ("doc_id", "source_path")


def directory_items(
    files: DataFrame,
    frame_counts: DataFrame | None = None,
    max_video_frames: int = MAX_FRAMES_IN_BATCH,
) -> DataFrame:
    """``doc_id, source_path, path, frame_idx, content`` of the processable files.

    ``files``: rows of ``read_files``. An image is one item with its content. A video gives an
    item per sampled frame, with the path and frame index only: its bytes are not repeated.
    ``frame_counts``: ``path, total_frames``; videos without a count or without frames have no
    items, and a row in ``directory_problems``.
    """
    found = discover(files)
    images = found.filter("kind = 'image'").select(
        F.col("path").alias("source_path"), "path",
        F.lit(None).cast("bigint").alias("frame_idx"), "content",
    )
    items = images
    if frame_counts is not None:
        videos = found.filter("kind = 'video'").select("path").join(frame_counts, "path")
        frames = sample_media(videos, "path", "total_frames", max_video_frames)
        items = images.unionByName(
            frames.select(
                "source_path", "path", "frame_idx", F.lit(None).cast("binary").alias("content")
            )
        )
    return items.withColumn("doc_id", document_id())


def directory_problems(files: DataFrame, frame_counts: DataFrame | None = None) -> DataFrame:
    """``path, error`` of videos that give no item: ``no_frame_count`` or ``no_frames``."""
    videos = discover(files).filter("kind = 'video'").select("path")
    if frame_counts is None:
        return videos.withColumn("error", F.lit("no_frame_count"))
    counts = frame_counts.groupBy(F.col("path").alias("_path")).agg(
        F.max("total_frames").alias("_total")
    )
    joined = videos.join(counts, F.col("path") == F.col("_path"), "left")
    error = F.when(F.col("_total").isNull(), "no_frame_count").when(F.col("_total") <= 0, "no_frames")
    return joined.select("path", error.alias("error")).filter("error IS NOT NULL")


def _members(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """Members by their archives' contents, or by ranges of the files where there are none."""
    if "content" in archives.columns:
        return expand_archives(archives, tasks=tasks)
    return expand_archive_files(archives, tasks=tasks)


def archive_items(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """``doc_id, archive, source_path, content`` of the readable members of accepted archives.

    ``archives``: ``path, length``, and ``content`` where it has been read; without it, members
    are read by ranges and archives may have any size. Broken archives and members are left
    out here; ``archive_problems`` has them.
    """
    accepted, _ = check_archives(archives)
    members = _members(accepted, tasks).filter(
        F.col("error").isNull() & F.col("content").isNotNull()
    )
    return members.select(
        F.sha2(F.concat_ws("::", "archive", "member"), 256).alias("doc_id"),
        "archive",
        F.col("member").alias("source_path"),
        "content",
    )


def archive_problems(archives: DataFrame) -> DataFrame:
    """``archive, member, error`` of rejected and broken archives and of unreadable members.

    ``member`` is null where the whole archive could not be used.
    """
    accepted, rejected = check_archives(archives)
    unread = _members(accepted).filter(F.col("error").isNotNull())
    return rejected.select(
        F.col("path").alias("archive"),
        F.lit(None).cast("string").alias("member"),
        F.col("reason").alias("error"),
    ).unionByName(unread.select("archive", "member", "error"))


def archive_reports(archives: DataFrame, results: DataFrame, problems: DataFrame) -> DataFrame:
    """One report per archive: totals of its members' ``results``, or why there are none.

    ``unreadable`` counts members that could not be read; ``error`` tells of the archive as a
    whole. Archives with the same path share a report.
    """
    listed = archives.select(F.col("path").alias("archive")).distinct()
    report = batch_report(results, by=["archive"], empty_message=NO_MEMBERS).drop("error")
    found = problems.groupBy("archive").agg(
        F.count("member").alias("unreadable"),
        F.max(F.when(F.col("member").isNull(), F.col("error"))).alias("error"),
    )
    totals = [c for c in report.columns if c != "archive"]
    joined = listed.join(report, listed["archive"].eqNullSafe(report["archive"]), "left").drop(
        report["archive"]
    )
    joined = joined.join(found, joined["archive"].eqNullSafe(found["archive"]), "left").drop(
        found["archive"]
    )
    none = F.when(F.col("total_documents").isNull(), F.lit(NO_MEMBERS))
    return joined.select(
        "archive",
        F.coalesce("error", none).alias("error"),
        F.coalesce("unreadable", F.lit(0)).alias("unreadable"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in totals],
    )


def process_items(
    items: DataFrame,
    function: Callable[[dict, Task], dict],
    schema: str,
    setup: Callable[[], object] | None = None,
    tasks: int | None = None,
    keep: tuple[str, ...] = KEPT,
) -> DataFrame:
    """Results of ``function`` for every item, failed ones included.

    ``tasks`` spreads the items first. Store the results before reporting on them, so that
    the function runs once.
    """
    spread = spread_documents(items, "doc_id", tasks) if tasks else items
    return map_documents(spread, function, schema, setup, keep)
