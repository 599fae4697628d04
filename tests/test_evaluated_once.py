from folioflow.operators.evaluate import evaluate
from folioflow.sources.sinks import read_evaluation, write_evaluation


def test_predictions_are_compared_once(spark, tmp_path):
    """Storing orders the details and sums them up without a second look at the predictions."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"f{i}.jpg", True, "Acme", None, 1.0 * i, "invoice", 2.0) for i in range(40)]
    predictions = spark.createDataFrame(
        rows, "file_path STRING, success BOOLEAN, vendor STRING, date DATE, amount DOUBLE, "
        "doc_type STRING, preprocessing_ms DOUBLE")
    predictions = predictions.mapInArrow(counted, predictions.schema)
    labels = spark.createDataFrame(
        [(f"f{i}.jpg", "ACME", None, 1.0 * i, "invoice") for i in range(30)],
        "file_path STRING, vendor_name STRING, invoice_date DATE, total_amount DOUBLE, "
        "doc_type STRING")
    write_evaluation(evaluate(labels, predictions), str(tmp_path / "out"))
    summary, details, _ = read_evaluation(spark, str(tmp_path / "out"))
    assert (summary.first().total_documents, details.count()) == (30, 30)
    assert seen.value == 40
