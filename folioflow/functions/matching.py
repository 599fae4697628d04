"""Predicates that compare a predicted field with its ground truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column, strip

AMOUNT_TOLERANCE = 0.01


def text_match(predicted: Column | str, truth: Column | str) -> Column:
    """Case-insensitive containment either way; false when either side is empty."""
    predicted, truth = as_column(predicted), as_column(truth)
    p, t = F.lower(strip(predicted)), F.lower(strip(truth))
    either = F.contains(p, t) | F.contains(t, p)
    return F.coalesce((predicted != "") & (truth != "") & either, F.lit(False))


def amount_match(
    predicted: Column | str, truth: Column | str, tolerance: float = AMOUNT_TOLERANCE
) -> Column:
    """Relative error strictly below the tolerance; both null match; zero matches zero only."""
    predicted, truth = as_column(predicted), as_column(truth)
    return (
        F.when(predicted.isNull() | truth.isNull(), predicted.eqNullSafe(truth))
        .when(truth == 0, predicted == 0)
        .otherwise(F.abs(truth - predicted) / F.abs(truth) < tolerance)
    )


def date_match(predicted: Column | str, truth: Column | str) -> Column:
    """Equality of canonical dates or stripped strings; no truth is no match."""
    p, t = (strip(as_column(c).cast("string")) for c in (predicted, truth))
    return F.coalesce(p == t, F.lit(False))


def doc_type_match(predicted: Column | str, truth: Column | str) -> Column:
    return F.coalesce(as_column(predicted) == F.lower(strip(truth)), F.lit(False))
