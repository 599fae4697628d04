"""Archives arriving as a stream: expand, map every member, report per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.documents import Task
from folioflow.plans.batch import (
    archive_items,
    archive_problems,
    archive_reports,
    process_items,
)


def report_stream(
    archives: DataFrame,
    function: Callable[[dict, Task], dict],
    schema: str,
    output: str,
    checkpoint: str,
    setup: Callable[[], object] | None = None,
    tasks: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start processing arriving archives (``path, length, content``) member by member.

    Each micro-batch writes ``results``, ``problems`` and ``reports``, a row per archive with
    the reason where one was rejected or broken, under folders of its own id, overwritten if
    the batch runs again. A report lasts from the first start to the last end of the archive's
    documents. ``trigger`` is passed on, ``{"processingTime": "10 seconds"}`` for one; without
    it all that is there is processed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        here = f"batch_id={batch_id}"
        items = archive_items(batch, tasks)
        kept = ("doc_id", "archive", "source_path")
        results = process_items(items, function, schema, setup, keep=kept)
        results.write.mode("overwrite").parquet(f"{output}/results/{here}")
        stored = batch.sparkSession.read.parquet(f"{output}/results/{here}")
        archive_problems(batch).write.mode("overwrite").parquet(f"{output}/problems/{here}")
        problems = batch.sparkSession.read.parquet(f"{output}/problems/{here}")
        report = archive_reports(batch, stored, problems)
        report.write.mode("overwrite").parquet(f"{output}/reports/{here}")

    return (
        archives.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
