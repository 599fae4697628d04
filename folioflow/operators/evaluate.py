"""Precision, recall and accuracy of predicted fields against a label table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.matching import amount_match, date_match, doc_type_match, text_match
from folioflow.functions.strings import strip

from .joins import duplicate_keys, first_per_key, lookup_join, small_side

# Labelled files up to which their names are broadcast, if their bytes allow it.
LABELLED_FILES = 1_000_000
# Fixed value: the overall accuracy a run should reach.
TARGET_ACCURACY = 0.95
FIELDS = ("vendor", "date", "amount")
LABEL_COLUMNS = {"vendor": "vendor_name", "date": "invoice_date", "amount": "total_amount"}


@dataclass(frozen=True)
class Evaluation:
    """Lazy results: one-row ``summary``, ``details`` per document, labels without a document."""

    summary: DataFrame
    details: DataFrame
    skipped: DataFrame
    duplicate_predictions: DataFrame
    target: float = TARGET_ACCURACY


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """``struct<precision, recall, f1>`` rounded to 4 places, 0 where undefined."""

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(F.lit(2.0) * precision * recall, precision + recall)
    return F.struct(
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The pages of labelled files; apply before fields are extracted from them.

    Labels are written by hand, so their files are mostly few: then the pages stay where they
    are read. Beyond the checked size of a broadcast the pages are shuffled by file.
    """
    wanted = labels.select("file_path").distinct()
    small = small_side(wanted, LABELLED_FILES)
    if small is wanted:
        return lookup_join(pages, wanted, ["file_path"], "left_semi")
    return pages.join(small, "file_path", "left_semi")


def compare(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Label rows with their prediction and match flags, by ``file_path``.

    ``predictions``: ``file_path, success, vendor, date, amount, doc_type, preprocessing_ms``,
    failed documents included. A null label value means the label holds no truth for the field,
    unless the label's ``malformed`` names it: then there is a truth, and nothing matches it.
    The file with the most labels may dominate: the join splits it, see ``lookup_join``.
    """
    truth = labels.select(
        "file_path",
        F.nullif(strip("vendor_name"), F.lit("")).alias("gt_vendor"),
        F.col("invoice_date").alias("gt_date"),
        F.col("total_amount").alias("gt_amount"),
        F.col("doc_type").alias("gt_doc_type"),
        _malformed(labels).alias("malformed"),
    )
    predicted = predictions.select(
        "file_path",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.nullif(strip("vendor"), F.lit("")).alias("pred_vendor"),
        F.col("date").alias("pred_date"),
        F.col("amount").alias("pred_amount"),
        F.col("doc_type").alias("pred_doc_type"),
        "preprocessing_ms",
    )
    value_columns = [c for c in predicted.columns if c != "file_path"]
    one_each = first_per_key(predicted, ["file_path"], value_columns)
    ok = F.col("success")
    return (
        lookup_join(truth, one_each, ["file_path"], "inner")
        .withColumn("vendor_match", ok & text_match("pred_vendor", "gt_vendor"))
        .withColumn("date_match", ok & date_match("pred_date", "gt_date"))
        .withColumn(
            "amount_match",
            ok & F.col("gt_amount").isNotNull() & amount_match("pred_amount", "gt_amount"),
        )
        .withColumn("doc_type_match", ok & doc_type_match("pred_doc_type", "gt_doc_type"))
    )


def _malformed(labels: DataFrame) -> Column:
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    return F.coalesce("malformed", none) if "malformed" in labels.columns else none


def confusion_counts(details: DataFrame) -> DataFrame:
    """True/false positives and false negatives of all three fields, and totals, in one pass."""
    ok = F.col("success")
    counts = [
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("doc_type_match")).alias("doc_type_correct"),
        F.round(
            F.coalesce(F.avg(F.when(ok, F.col("preprocessing_ms"))), F.lit(0.0)), 2
        ).alias("avg_preprocessing_ms"),
    ]
    for field in FIELDS:
        match = F.col(f"{field}_match")
        unread = F.array_contains("malformed", LABEL_COLUMNS[field])
        truth = F.col(f"gt_{field}").isNotNull() | unread
        guess = F.col(f"pred_{field}").isNotNull()
        counts += [
            F.count_if(match).alias(f"{field}_tp"),
            F.count_if(ok & ~match & guess).alias(f"{field}_fp"),
            F.count_if(ok & ~match & truth).alias(f"{field}_fn"),
        ]
    return details.agg(*counts)


def score(counts: DataFrame, target: float = TARGET_ACCURACY) -> DataFrame:
    """Confusion counts extended by metrics per field, accuracies and the target flag."""
    total = F.col("total_documents")
    hits = F.col("vendor_tp") + F.col("date_tp") + F.col("amount_tp")
    overall = F.when(total > 0, hits / (total * 3)).otherwise(0.0)
    types = F.when(total > 0, F.col("doc_type_correct") / total).otherwise(0.0)
    return counts.select(
        "*",
        *[
            precision_recall_f1(*[F.col(f"{f}_{k}") for k in ("tp", "fp", "fn")]).alias(f)
            for f in FIELDS
        ],
        F.round(overall, 4).alias("overall_accuracy"),
        F.round(types, 4).alias("doc_type_accuracy"),
        (overall >= target).alias("target_met"),
    )


def metrics_by_field(summary: DataFrame) -> DataFrame:
    """Long form of the summary: one row per field."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                *[F.col(f"{f}_{k}").alias(k) for k in ("tp", "fp", "fn")],
                *[F.col(f"{f}.{m}").alias(m) for m in ("precision", "recall", "f1")],
            )
            for f in FIELDS
        ]
    )
    return summary.select(F.inline(rows))


def evaluate(labels: DataFrame, predictions: DataFrame) -> Evaluation:
    """Compare, count and score; persist ``details`` when both it and the summary are written."""
    details = compare(labels, predictions)
    known = predictions.select("file_path").distinct()
    return Evaluation(
        summary=score(confusion_counts(details)),
        details=details,
        skipped=lookup_join(labels, known, ["file_path"], "left_anti"),
        duplicate_predictions=duplicate_keys(predictions, ["file_path"]),
    )
