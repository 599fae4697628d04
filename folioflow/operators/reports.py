"""One-row reports over batch results, request latencies and step timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.timing import (
    MANUAL_MS_PER_DOC,
    SLA_THRESHOLD_MS,
    breaches_sla,
    overhead_reduction_pct,
    ranked_percentile,
    within_sla,
)

from .sampling import HISTORY_SIZE, newest

# Texts reported for an empty batch.
NO_FILES = "No processable files found in directory"
NO_MEMBERS = "No valid images found in ZIP archive"


def share_pct(part: Column, whole: Column, digits: int) -> Column:
    """``part`` of ``whole`` in percent, 0 of nothing."""
    return F.when(
        whole > 0, F.round(part.cast("double") / whole * F.lit(100.0), digits)
    ).otherwise(0.0)


def batch_report(
    results: DataFrame,
    elapsed_sec: float | None = None,
    by: Sequence[str] = (),
    threshold_ms: float = SLA_THRESHOLD_MS,
    empty_message: str = NO_FILES,
) -> DataFrame:
    """Totals, throughput and latency of ``success, total_ms`` rows, overall or per batch.

    Latencies cover successes; the share below the threshold is of all documents. Without
    ``elapsed_sec`` the batch lasts from the first ``started_at`` to the last ``finished_at``.
    """
    ok = F.col("success")
    if elapsed_sec is not None:
        elapsed = F.lit(float(elapsed_sec))
    else:
        elapsed = F.max("finished_at").cast("double") - F.min("started_at").cast("double")
    grouped = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(ok).alias("successful"),
        F.coalesce(elapsed, F.lit(0.0)).alias("_elapsed"),
        F.coalesce(F.avg(F.when(ok, F.col("total_ms"))), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.max(F.when(ok, F.col("total_ms"))), F.lit(0.0)).alias("_max"),
        F.count_if(ok & within_sla("total_ms", threshold_ms)).alias("_fast"),
    )
    total, elapsed = F.col("total_documents"), F.col("_elapsed")
    return grouped.select(
        *by,
        total,
        F.col("successful"),
        (total - F.col("successful")).alias("failed"),
        F.round(elapsed, 3).alias("total_elapsed_sec"),
        F.when(elapsed > 0, F.round(total / elapsed, 2))
        .otherwise(0.0)
        .alias("throughput_docs_per_sec"),
        F.round("_avg", 2).alias("avg_latency_ms"),
        F.round("_max", 2).alias("max_latency_ms"),
        share_pct(F.col("_fast"), total, 1).alias("sub_2s_transactions_pct"),
        F.when(total == 0, empty_message).alias("error"),
    )


def success_split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful and failed rows; persist ``results`` first when both are used."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.filter(ok), results.filter(~ok)


def latency_metrics(
    requests: DataFrame,
    order: Sequence[str] = ("ts",),
    elapsed_ms: str = "elapsed_ms",
    history: int = HISTORY_SIZE,
    threshold_ms: float = SLA_THRESHOLD_MS,
) -> DataFrame:
    """Percentiles, mean, maximum and violation share of the newest ``history`` requests.

    ``order`` names the time column, then tie-breakers. No request at all gives a row of zeros.
    """
    recent = newest(requests.select(*order, elapsed_ms), order, history)
    return latency_metrics_by(recent, (), elapsed_ms, threshold_ms)


def latency_metrics_by(
    requests: DataFrame,
    by: Sequence[str],
    elapsed_ms: str = "elapsed_ms",
    threshold_ms: float = SLA_THRESHOLD_MS,
) -> DataFrame:
    """The metrics over all the given requests of each group, which must be a history's at most."""
    stats = requests.groupBy(*by).agg(
        F.sort_array(F.collect_list(elapsed_ms)).alias("_ms"),
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.avg(elapsed_ms), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.max(elapsed_ms), F.lit(0.0)).alias("_max"),
        F.count_if(breaches_sla(elapsed_ms, threshold_ms)).alias("_breaches"),
    )
    return stats.select(
        *by,
        "total_requests",
        *[F.round(ranked_percentile(F.col("_ms"), p), 2).alias(f"p{p}_ms") for p in (50, 95, 99)],
        F.round("_avg", 2).alias("avg_ms"),
        F.round("_max", 2).alias("max_ms"),
        share_pct(F.col("_breaches"), F.col("total_requests"), 2).alias("sla_violation_pct"),
        F.lit(threshold_ms).alias("sla_threshold_ms"),
    )


def mean_preprocessing_ms(results: DataFrame, column: str = "preprocessing_ms") -> DataFrame:
    """Mean over the processed documents, 0 when there are none."""
    return results.agg(
        F.round(F.coalesce(F.avg(column), F.lit(0.0)), 2).alias("avg_ms_per_doc")
    )


def timing_report(
    timings: DataFrame, elapsed_ms: str = "elapsed_ms", manual_ms: float = MANUAL_MS_PER_DOC
) -> DataFrame:
    """Totals and extremes of per-document times, and the effort saved against manual review."""
    stats = timings.agg(
        F.count(F.lit(1)).alias("num_documents"),
        F.coalesce(F.sum(elapsed_ms), F.lit(0.0)).alias("_total"),
        F.coalesce(F.avg(elapsed_ms), F.lit(0.0)).alias("_avg"),
        F.coalesce(F.min(elapsed_ms), F.lit(0.0)).alias("_min"),
        F.coalesce(F.max(elapsed_ms), F.lit(0.0)).alias("_max"),
        F.coalesce(F.avg(overhead_reduction_pct(elapsed_ms, manual_ms)), F.lit(0.0)).alias("_saved"),
    )
    manual_total = F.col("num_documents") * F.lit(manual_ms)
    return stats.select(
        "num_documents",
        F.round("_total", 2).alias("total_ms"),
        F.round("_avg", 2).alias("avg_ms_per_doc"),
        F.round("_min", 2).alias("min_ms"),
        F.round("_max", 2).alias("max_ms"),
        F.round("_saved", 1).alias("avg_overhead_reduction_pct"),
        F.round(manual_total / F.lit(1000.0), 2).alias("manual_total_s"),
        F.when(
            F.col("num_documents") > 0,
            F.round((manual_total - F.col("_total")) / manual_total * F.lit(100.0), 1),
        )
        .otherwise(0.0)
        .alias("overhead_reduction_pct"),
    )
