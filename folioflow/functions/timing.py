"""Latency arithmetic: percentile rule, SLA predicate, overhead share, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column

# Service target and the manual effort a document is compared with.
SLA_THRESHOLD_MS = 2000.0
MANUAL_MS_PER_DOC = 30000.0


def ranked_percentile(ordered: Column, percent: float) -> Column:
    """Value at index ``round(percent/100 * n)`` of a sorted array, clamped, no interpolation.

    Half indices round to even; an empty array gives 0. ``ordered`` should be a plain
    column, since it is read more than once.
    """
    n = F.size(ordered)
    index = F.bround(F.lit(percent / 100.0) * n).cast("int")
    return F.when(n > 0, F.get(ordered, F.greatest(F.lit(0), F.least(n - 1, index)))).otherwise(0.0)


def breaches_sla(elapsed_ms: Column | str, threshold_ms: float = SLA_THRESHOLD_MS) -> Column:
    """Strictly above the threshold."""
    return as_column(elapsed_ms) > F.lit(threshold_ms)


def within_sla(elapsed_ms: Column | str, threshold_ms: float = SLA_THRESHOLD_MS) -> Column:
    """Strictly below the threshold; the threshold itself is neither fast nor a breach."""
    return as_column(elapsed_ms) < F.lit(threshold_ms)


def overhead_reduction_pct(
    elapsed_ms: Column | str, manual_ms: float = MANUAL_MS_PER_DOC
) -> Column:
    """Share of manual effort saved, in percent with one decimal, never below 0."""
    saved = (F.lit(manual_ms) - as_column(elapsed_ms)) / F.lit(manual_ms) * F.lit(100.0)
    return F.round(F.greatest(F.lit(0.0), saved), 1)


def process_time_header(elapsed_ms: Column | str) -> Column:
    return F.format_string("%.2f", as_column(elapsed_ms))


def log_level(elapsed_ms: Column | str, threshold_ms: float = SLA_THRESHOLD_MS) -> Column:
    return F.when(breaches_sla(elapsed_ms, threshold_ms), "WARNING").otherwise("INFO")


def log_line(method, path, elapsed_ms, threshold_ms: float = SLA_THRESHOLD_MS) -> Column:
    """One line per request; a breach names the threshold it crossed."""
    method, path, elapsed_ms = map(as_column, (method, path, elapsed_ms))
    return F.when(
        breaches_sla(elapsed_ms, threshold_ms),
        F.format_string(
            f"SLA BREACH — %s %s took %.1f ms (threshold: {threshold_ms} ms)",
            method, path, elapsed_ms,
        ),
    ).otherwise(F.format_string("%s %s — %.1f ms", method, path, elapsed_ms))
