"""Extraction and breach alerts over streams: the batch functions on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.timing import SLA_THRESHOLD_MS, breaches_sla, log_level, log_line
from folioflow.operators.vendors import NameIndex
from folioflow.plans.extract import extract_documents, with_vendor_table


def extract_stream(
    documents: DataFrame,
    output: str,
    checkpoint: str,
    known_vendor: Column | None = None,
    file_format: str = "parquet",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start writing one response row per arriving document. Stateless, exactly once in files.

    A micro-batch of one large file is one task; repartition ``documents`` where that is so.
    """
    return (
        extract_documents(documents, known_vendor=known_vendor)
        .writeStream.format(file_format)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def extract_stream_with_names(
    documents: DataFrame,
    names: NameIndex,
    output: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The same with known vendors from an indexed table of names.

    Each micro-batch writes a folder of its own id under ``output``, overwritten if the batch
    runs again; the index is read, not made, by every batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        extracted = with_vendor_table(extract_documents(batch), batch, names)
        extracted.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def breach_alerts(requests: DataFrame, threshold_ms: float = SLA_THRESHOLD_MS) -> DataFrame:
    """Requests over the threshold with their log line, for a batch or a stream."""
    return requests.filter(breaches_sla("elapsed_ms", threshold_ms)).withColumns(
        {
            "level": log_level("elapsed_ms", threshold_ms),
            "message": log_line("method", "path", "elapsed_ms", threshold_ms),
        }
    )


def request_log(requests: DataFrame, threshold_ms: float = SLA_THRESHOLD_MS) -> DataFrame:
    """Every request with its header value, level and log line."""
    return requests.withColumns(
        {
            "process_time_ms": F.format_string("%.2f", F.col("elapsed_ms")),
            "level": log_level("elapsed_ms", threshold_ms),
            "message": log_line("method", "path", "elapsed_ms", threshold_ms),
        }
    )
