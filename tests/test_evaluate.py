import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions.matching import amount_match, doc_type_match, text_match
from folioflow.operators.evaluate import evaluate, metrics_by_field, precision_recall_f1
from folioflow.operators.joins import first_per_key, lookup_join, small_side
from folioflow.plans.extract import predict_first_pages
from folioflow.schemas import LABELS

DAY = datetime.date(2024, 1, 15)
PREDICTIONS = (
    "file_path STRING, success BOOLEAN, vendor STRING, date DATE, amount DOUBLE, "
    "doc_type STRING, preprocessing_ms DOUBLE"
)


def test_predicates(spark):
    cases = [("Acme", "the ACME Co", True), ("the acme co", " Acme ", True), ("", "x", False),
             ("x", None, False), (None, None, False), ("abc", "abd", False)]
    frame = spark.createDataFrame([c[:2] for c in cases], "p STRING, t STRING")
    assert [r[0] for r in frame.select(text_match("p", "t")).collect()] == [c[2] for c in cases]
    cases = [(None, None, True), (1.0, None, False), (None, 1.0, False), (0.0, 0.0, True),
             (0.1, 0.0, False), (99.5, 100.0, True), (99.0, 100.0, False), (101.0, 100.0, False),
             (-100.5, -100.0, True)]
    frame = spark.createDataFrame([c[:2] for c in cases], "p DOUBLE, t DOUBLE")
    assert [r[0] for r in frame.select(amount_match("p", "t")).collect()] == [c[2] for c in cases]
    frame = spark.createDataFrame([("invoice", " Invoice"), ("receipt", None)], "p STRING, t STRING")
    assert [r[0] for r in frame.select(doc_type_match("p", "t")).collect()] == [True, False]


def test_scores(spark):
    frame = spark.createDataFrame([(0, 0, 0), (2, 1, 0), (0, 3, 3)], "tp INT, fp INT, fn INT")
    scored = frame.select(precision_recall_f1(*map(F.col, ("tp", "fp", "fn"))).alias("s")).collect()
    assert [tuple(r.s) for r in scored] == [(0.0, 0.0, 0.0), (0.6667, 1.0, 0.8), (0.0, 0.0, 0.0)]


@pytest.fixture
def tables(spark):
    labels = spark.createDataFrame([
        ("1", "a.jpg", "Acme", DAY, 100.0, "invoice"),
        ("2", "b.jpg", "Acme", DAY, 100.0, "receipt"),
        ("3", "c.jpg", None, None, None, "invoice"),
        ("4", "d.jpg", "Acme", DAY, 100.0, "invoice"),
        ("5", "gone.jpg", "Acme", DAY, 100.0, "invoice"),
        ("6", "e.jpg", "Acme", DAY, 100.0, "invoice"),
    ], LABELS)
    predictions = spark.createDataFrame([
        ("a.jpg", True, "ACME Ltd", DAY, 100.5, "invoice", 10.0),
        ("b.jpg", True, "Other", None, 5.0, "invoice", 20.0),
        ("c.jpg", True, "Guess", DAY, 1.0, "unknown", 30.0),
        ("d.jpg", False, None, None, None, None, None),
        ("e.jpg", True, None, None, None, "receipt", 40.0),
        ("extra.jpg", True, "x", DAY, 1.0, "invoice", 99.0),
    ], PREDICTIONS)
    return labels, predictions


def test_evaluate(spark, tables):
    found = evaluate(*tables)
    s = found.summary.first()
    assert (s.total_documents, s.failed, s.doc_type_correct) == (5, 1, 1)
    assert (s.vendor_tp, s.vendor_fp, s.vendor_fn) == (1, 2, 2)
    assert (s.date_tp, s.date_fp, s.date_fn) == (1, 1, 2)
    assert (s.amount_tp, s.amount_fp, s.amount_fn) == (1, 2, 2)
    assert tuple(s.vendor) == (0.3333, 0.3333, 0.3333)
    assert (s.overall_accuracy, s.doc_type_accuracy, s.target_met) == (0.2, 0.2, False)
    assert s.avg_preprocessing_ms == 25.0
    assert [r.file_path for r in found.skipped.collect()] == ["gone.jpg"]
    assert found.duplicate_predictions.count() == 0
    assert {r.field for r in metrics_by_field(found.summary).collect()} == {
        "vendor", "date", "amount"}


def test_perfect_and_empty_runs(spark, tables):
    labels, predictions = tables
    perfect = evaluate(labels.filter("doc_id = '1'"), predictions).summary.first()
    assert perfect.target_met and perfect.overall_accuracy == 1.0
    nothing = evaluate(labels.limit(0), predictions).summary.first()
    assert nothing.total_documents == 0 and nothing.overall_accuracy == 0.0
    assert not nothing.target_met


def test_duplicates_do_not_fan_out(spark, tables):
    labels, predictions = tables
    found = evaluate(labels.unionByName(labels), predictions.unionByName(predictions))
    assert found.summary.first().total_documents == 10
    assert found.duplicate_predictions.count() == 6


def test_predictions_from_pages(spark):
    pages = spark.createDataFrame([
        ("a.jpg", 0, "Acme Foods\nDate: 2024-01-15\nInvoice Total: $1,100.00", True, 5.0, 99.9),
        ("a.jpg", 1, "Total: $9,999.00", True, 5.0, 99.9),
        ("b.jpg", 0, "text of a failed page", False, 5.0, 99.9),
    ], "file_path STRING, page INT, text STRING, success BOOLEAN, preprocessing_ms DOUBLE, "
       "overhead_reduction_pct DOUBLE")
    rows = {r.file_path: r for r in predict_first_pages(pages).collect()}
    assert len(rows) == 2
    a, b = rows["a.jpg"], rows["b.jpg"]
    assert (a.vendor, a.date, a.amount, a.doc_type) == ("Acme Foods", DAY, 1100.0, "invoice")
    assert (b.vendor, b.date, b.amount, b.doc_type, b.success) == (None, None, None, None, False)


def test_lookup_join_splits_a_hot_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
        right = first_per_key(
            spark.range(0, 60000, 1, 8).selectExpr("id % 30000 AS k", "id AS v"), ["k"], ["v"])
        joined = lookup_join(left, right, ["k"])
        assert joined.filter("k = 7").count() == 20001
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan


def test_small_side_checks_the_size(spark):
    frame = spark.range(50)
    hinted = small_side(frame, 50)
    assert hinted is not frame and small_side(frame, 49) is frame
