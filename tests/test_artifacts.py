import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import evaluate as evaluation_module
from folioflow.operators.evaluate import evaluate, labelled_pages
from folioflow.operators.joins import small_side
from folioflow.sources.sinks import read_evaluation, write_evaluation
from folioflow.streaming import artifacts


def document(ident, arrived, *pages):
    corner = [{"x": 0, "y": 0}] * 4
    return (ident, arrived, [
        {"page": n, "engine": "easyocr", "tokens": [{"text": t, "confidence": 0.9, "bbox": corner}]}
        for n, t in enumerate(pages)])


def test_a_document_that_arrives_again_leaves_one_version(spark, tmp_path):
    folder, root, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batches = [
        [document("a", 1, "Invoice", "Total: $5.00"), document("b", 1, "Receipt"), document("c", 1, "x")],
        [document("a", 2, "Receipt"), document("a", 3, "Statement", "p", "q"), document("d", 2)],
        [document("c", 4)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, artifacts.DOCUMENTS).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(artifacts.DOCUMENTS).parquet(folder)
        artifacts.keep_artifacts(stream, root, mark, buckets=3).awaitTermination()
    kinds = {r.doc_id: r.doc_type for r in artifacts.stored_extractions(spark, root).collect()}
    assert kinds == {"a": "unknown", "b": "receipt", "c": "unknown", "d": "unknown"}
    pages = artifacts.stored_pages(spark, root).collect()
    found = sorted((r.doc_id, r.page, r.tokens[0].text) for r in pages)
    assert found == [("a", 0, "Statement"), ("a", 1, "p"), ("a", 2, "q"), ("b", 0, "Receipt")]


def labels_and_predictions(spark, count):
    day = datetime.date(2024, 1, 1)
    labels = spark.createDataFrame(
        [(str(i), f"f{i:04d}", f"Shop {i}", day, float(i), "invoice") for i in range(count)],
        "doc_id STRING, file_path STRING, vendor_name STRING, invoice_date DATE, total_amount DOUBLE,"
        " doc_type STRING")
    predictions = spark.createDataFrame(
        [(f"f{i:04d}", i % 10 != 3, f"Shop {i}", day, float(i + (i % 4 == 0)), "invoice", 2.0)
         for i in range(count)],
        "file_path STRING, success BOOLEAN, vendor STRING, date DATE, amount DOUBLE, doc_type STRING,"
        " preprocessing_ms DOUBLE")
    return labels, predictions


@pytest.mark.parametrize("count", [0, 500])
def test_evaluation_is_stored_in_parts(spark, tmp_path, count):
    path = str(tmp_path / "report")
    evaluation = evaluate(*labels_and_predictions(spark, count))
    for _ in range(2):  # again over what is there
        write_evaluation(evaluation, path)
    if count:
        summary, details, manifest = read_evaluation(spark, path)
        (row,) = summary.collect()
        expected = evaluation.summary.first()
        assert row.metrics.vendor.f1 == expected.vendor.f1 and row.details.rows == count
        assert row.metrics.overall_accuracy == expected.overall_accuracy
        parts = manifest.orderBy("part").collect()
        assert sum(p.rows for p in parts) == count and row.details.files == len(parts)
        assert all(a.last_file <= b.first_file for a, b in zip(parts, parts[1:]))
        files = [r.file_path for p in parts for r in details.filter(F.col("part") == p.part).collect()]
        assert sorted(files) == [f"f{i:04d}" for i in range(count)]
    (written,) = (tmp_path / "report" / "summary").glob("part-*.json")
    document = json.loads(written.read_text())
    assert document["total_documents"] == count and document["details"]["rows"] == count
    assert set(document["metrics"]) == {"overall_accuracy", "doc_type_accuracy", "vendor", "date", "amount"}


def test_small_sides_are_few_rows_and_few_bytes(spark):
    few = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    hinted = small_side(few)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted
    assert small_side(few, max_rows=9) is few and small_side(few, max_bytes=9000) is few
    nested = few.select(F.array("text", "text").alias("a"))
    assert small_side(nested, max_bytes=30_000) is nested


@pytest.mark.parametrize("rows", [100, 0])
def test_labelled_pages_by_broadcast_or_shuffle(spark, monkeypatch, rows):
    monkeypatch.setattr(evaluation_module, "LABELLED_FILES", rows)
    labels = spark.createDataFrame([("a",), ("a",), ("b",)], "file_path STRING")
    pages = spark.createDataFrame([("a", 0), ("a", 1), ("c", 0), (None, 0)], "file_path STRING, page INT")
    kept = labelled_pages(pages, labels)
    assert sorted(map(tuple, kept.collect())) == [("a", 0), ("a", 1)]
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert ("ResolvedHint" in plan) == (rows > 0)
