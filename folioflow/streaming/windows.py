"""Latency by event-time window, with a state that merges and late requests left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.timing import SLA_THRESHOLD_MS, breaches_sla
from folioflow.operators.reports import share_pct
from folioflow.operators.sampling import HISTORY_SIZE

PERCENTILES = (50, 95, 99)
# Values of a window up to which percentiles follow the index rule exactly, and the size of the
# quantile sketch, which keeps all values up to there and has a rank error of about 0.13 % (at
# 99 % confidence) beyond.
EXACT_VALUES = HISTORY_SIZE
SKETCH_SIZE = 4096


def latency_windows(
    requests: DataFrame,
    width: str = "1 hour",
    late_by: str = "10 minutes",
    by: Sequence[str] = ("path",),
    slide: str | None = None,
    time: str = "ts",
    elapsed_ms: str = "elapsed_ms",
    threshold_ms: float = SLA_THRESHOLD_MS,
) -> DataFrame:
    """State of each window and group of a batch or a stream, for ``window_metrics``.

    Columns: ``window_start, window_end``, ``by``, ``total_requests, measured, sum_ms, max_ms,
    breaches, sketch``. The state of a window has a bounded size, however many requests it
    sees: parts of it are combined before the shuffle, so a group with most of the requests
    is no hot spot. On a stream a window is closed once the newest time seen lies ``late_by``
    beyond its end; requests that come later than that are left out, and Spark counts them
    (``numRowsDroppedByWatermark`` in the progress). ``slide`` gives overlapping windows.
    Requests without a time belong to no window; one without a duration counts as a request
    only. Null groups are groups of their own. A time without a zone is one of the session's.
    """
    window = F.window(time, width, slide or width)
    state = (
        requests.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late_by)
        .groupBy(window.alias("_window"), *by)
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count(elapsed_ms).alias("measured"),
            F.sum(elapsed_ms).alias("sum_ms"),
            F.max(elapsed_ms).alias("max_ms"),
            F.count_if(breaches_sla(elapsed_ms, threshold_ms)).alias("breaches"),
            F.kll_sketch_agg_double(elapsed_ms, F.lit(SKETCH_SIZE)).alias("sketch"),
        )
    )
    rest = [c for c in state.columns if c not in ("_window", *by)]
    return state.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *by,
        *rest,
    )


def merge_windows(
    windows: DataFrame, width: str, by: Sequence[str] = ("path",), slide: str | None = None
) -> DataFrame:
    """Windows put together to wider ones, from their states alone.

    ``width`` should be a multiple of theirs, else a window counts where it starts.
    """
    window = F.window("window_start", width, slide or width)
    merged = windows.groupBy(window.alias("_window"), *by).agg(
        *[F.sum(c).alias(c) for c in ("total_requests", "measured", "sum_ms")],
        F.max("max_ms").alias("max_ms"),
        F.sum("breaches").alias("breaches"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"),
    )
    rest = [c for c in merged.columns if c not in ("_window", *by)]
    return merged.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *by,
        *rest,
    )


def sketched_percentile(sketch: Column, count: Column, percent: float) -> Column:
    """The percentile of ``count`` values by the index rule, exact up to ``EXACT_VALUES``.

    The sketch answers constant ranks only, so it is asked for the rank of the wanted index
    among 1, 2, 3 ... values at once, and the answer for ``count`` is taken.
    """
    ranks = []
    for n in range(1, EXACT_VALUES + 1):
        index = max(0, min(n - 1, round(percent / 100.0 * n)))
        ranks.append((index + 0.5) / n)
    few = F.get(F.kll_sketch_get_quantile_double(sketch, F.lit(ranks)), count.cast("int") - 1)
    many = F.kll_sketch_get_quantile_double(sketch, F.lit(percent / 100.0))
    return F.when(count == 0, 0.0).when(count <= EXACT_VALUES, few).otherwise(many)


def window_metrics(windows: DataFrame, threshold_ms: float = SLA_THRESHOLD_MS) -> DataFrame:
    """Percentiles, mean, maximum and violation share of each window."""
    state = ("total_requests", "measured", "sum_ms", "max_ms", "breaches", "sketch")
    mean = F.when(F.col("measured") > 0, F.col("sum_ms") / F.col("measured")).otherwise(0.0)
    return windows.select(
        *[c for c in windows.columns if c not in state],
        "total_requests",
        *[
            F.round(sketched_percentile(F.col("sketch"), F.col("measured"), p), 2).alias(f"p{p}_ms")
            for p in PERCENTILES
        ],
        F.round(mean, 2).alias("avg_ms"),
        F.round(F.coalesce("max_ms", F.lit(0.0)), 2).alias("max_ms"),
        share_pct(F.col("breaches"), F.col("total_requests"), 2).alias("sla_violation_pct"),
        F.lit(threshold_ms).alias("sla_threshold_ms"),
    )


def keep_windows(
    windows: DataFrame,
    output: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start storing the windows of a stream as they close, each once, exactly once in files."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
