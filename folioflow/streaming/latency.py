"""Rolling latency metrics: a bounded history refreshed by every micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.reports import latency_metrics
from folioflow.operators.sampling import HISTORY_SIZE, newest


def _slot(root: str, batch_id: int) -> str:
    return f"{root}/slot={batch_id % 2}"


def _read_slot(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def refresh_history(
    batch: DataFrame, batch_id: int, root: str, order: Sequence[str], history: int = HISTORY_SIZE
) -> None:
    """Write the newest rows of the previous history and this batch.

    Two slots alternate: batch n reads slot n-1 and overwrites slot n, so running a batch
    again after a failure gives the same history.
    """
    spark = batch.sparkSession
    columns = [*order, "elapsed_ms"]
    merged = newest(batch.select(*columns), order, history).withColumn(
        "batch_id", F.lit(batch_id).cast("bigint")
    )
    if batch_id > 0:
        earlier = _read_slot(spark, _slot(root, batch_id - 1), merged.schema)
        if earlier is not None:
            kept = earlier.filter(F.col("batch_id") == batch_id - 1)
            merged = newest(
                merged.unionByName(kept.withColumn("batch_id", F.lit(batch_id).cast("bigint"))),
                order,
                history,
            )
    merged.coalesce(1).write.mode("overwrite").parquet(_slot(root, batch_id))


def keep_history(
    requests: DataFrame,
    root: str,
    checkpoint: str,
    order: Sequence[str] = ("ts",),
    history: int = HISTORY_SIZE,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start keeping the newest requests of a stream under ``root``."""
    return (
        requests.writeStream.foreachBatch(
            lambda batch, batch_id: refresh_history(batch, batch_id, root, order, history)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_metrics(
    spark: SparkSession, root: str, requests_schema, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Snapshot of the metrics from the history last written; zeros before the first batch."""
    columns = [*order, "elapsed_ms"]
    schema = spark.createDataFrame([], requests_schema).select(*columns).withColumn(
        "batch_id", F.lit(0).cast("bigint")
    ).schema
    slots = [s for s in (_read_slot(spark, _slot(root, n), schema) for n in (0, 1)) if s is not None]
    if not slots:
        return latency_metrics(spark.createDataFrame([], schema), order)
    rows = slots[0] if len(slots) == 1 else slots[0].unionByName(slots[1])
    last = rows.agg(F.max("batch_id").alias("_last"))
    latest = rows.join(F.broadcast(last), F.col("batch_id") == F.col("_last"), "left_semi")
    return latency_metrics(latest, order)
