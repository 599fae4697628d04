"""Writers for extraction artifacts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.evaluate import FIELDS, Evaluation, confusion_counts, score
from folioflow.session import scratch_path


def write_artifacts(
    extractions: DataFrame,
    pages: DataFrame | None,
    path: str,
    doc_id: str = "doc_id",
    buckets: int | None = None,
    file_format: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Store ``<path>/extractions`` and ``<path>/pages`` with the document id as a column.

    ``buckets`` adds folders by a hash of the id; the rebalance hint then lets adaptive
    execution choose file sizes. There is never a folder per document.
    """
    for name, table in (("extractions", extractions), ("pages", pages)):
        if table is None:
            continue
        if buckets is None:
            writer = table.write
        else:
            bucket = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(buckets)).cast("int")
            foldered = table.withColumn("bucket", bucket).hint("rebalance", "bucket")
            writer = foldered.write.partitionBy("bucket")
        writer.mode(mode).format(file_format).save(f"{path}/{name}")


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a one-row report as a single JSON file with the time of the run."""
    report.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode(mode).json(path)


def evaluation_report(summary: DataFrame, manifest: DataFrame) -> DataFrame:
    """The nested one-row report of an evaluation; ``manifest`` tells where its details are."""
    counts = F.struct(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files")
    )
    metrics = F.struct("overall_accuracy", "doc_type_accuracy", *FIELDS)
    return summary.select(
        F.current_timestamp().alias("timestamp"),
        "total_documents",
        "failed",
        metrics.alias("metrics"),
        F.struct(F.col("avg_preprocessing_ms").alias("avg_ms_per_doc")).alias("preprocessing"),
        "target_met",
        manifest.agg(counts.alias("counts")).scalar().alias("details"),
    )


def write_evaluation(evaluation: Evaluation, path: str, mode: str = "overwrite") -> None:
    """Store an evaluation as one nested document, and its details in ordered part files.

    ``<path>/details`` holds a JSON line per document, sorted by file within and across the
    parts, so that no row and no task holds all of them. ``<path>/manifest`` has a row per part:
    ``part, rows, first_file, last_file``. ``<path>/summary`` is the document, with counts of
    details instead of the details. The comparison runs once: its rows are kept in the scratch
    folder, as ordering them reads them twice and the summary counts them.
    """
    spark = evaluation.details.sparkSession
    kept = scratch_path(spark, "details")
    evaluation.details.write.parquet(kept)
    details = spark.read.schema(evaluation.details.schema).parquet(kept)
    summary = score(confusion_counts(details), evaluation.target)
    order = ["file_path", "gt_vendor", "gt_date", "gt_amount", "gt_doc_type"]
    details.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
        mode
    ).json(f"{path}/details")
    stored = spark.read.schema(evaluation.details.schema).json(f"{path}/details")
    manifest = stored.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("file_path").alias("first_file"),
        F.max("file_path").alias("last_file"),
    )
    manifest.repartitionByRange("part").sortWithinPartitions("part").write.mode(mode).json(
        f"{path}/manifest"
    )
    listed = spark.read.schema(manifest.schema).json(f"{path}/manifest")
    evaluation_report(summary, listed).coalesce(1).write.mode(mode).json(
        f"{path}/summary"
    )


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored ``summary``, ``details`` (with their ``part``) and ``manifest``."""
    details = spark.read.json(f"{path}/details")
    return (
        spark.read.json(f"{path}/summary"),
        details.withColumn("part", F.col("_metadata.file_name")),
        spark.read.json(f"{path}/manifest"),
    )
