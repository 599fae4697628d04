import pytest
from pyspark.sql import functions as F

from folioflow.functions.vendor import known_name
from folioflow.operators import vendors
from folioflow.operators.vendors import vendor_mentions
from folioflow.plans.extract import extract_documents, with_vendor_table
from folioflow.streaming.extract import extract_stream_with_names

NAMES = ["Green Garden", "Green Garden Ltd.", "Burger Barn", "A.B. Foods", "of", " , "]
TEXTS = ["hello (GREEN   garden) and Burger Barn", "to green garden\nLtd, x", "evergreen garden",
         "x" * 600 + " Burger Barn", "made of a.b. foods", "", None, "Burger Barn of Green Garden"]
EXPECTED = {0: "Green Garden", 1: "Green Garden Ltd.", 4: "of", 7: "Burger Barn"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_mentions(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(vendors, "small_side", lambda df: df)
        monkeypatch.setattr(vendors, "HOT_ROWS", 1)
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id INT, text STRING")
    names = spark.createDataFrame([(n,) for n in NAMES], "name STRING")
    found = {r.doc_id: r.vendor for r in vendor_mentions(documents, names).collect()}
    assert found == EXPECTED
    literal = documents.select("doc_id", known_name("text", NAMES).alias("v"))
    assert {r.doc_id: r.v for r in literal.filter("v IS NOT NULL").collect()} == EXPECTED


def test_no_names(spark):
    documents = spark.createDataFrame([(1, "a")], "doc_id INT, text STRING")
    names = spark.createDataFrame([], "name STRING")
    assert vendor_mentions(documents, names).count() == 0


def test_vendor_table_in_the_response(spark):
    documents = spark.createDataFrame(
        [(1, "Dear Sirs\nBurger Barn"), (2, "Dear Sirs"), (3, "")], "doc_id INT, text STRING")
    names = spark.createDataFrame([("Burger Barn",)], "name STRING")
    extracted = with_vendor_table(extract_documents(documents), documents, names)
    vendor = F.col("fields.vendor_name")
    rows = extracted.select("doc_id", vendor["value"], vendor["confidence"]).orderBy("doc_id")
    assert [tuple(r) for r in rows.collect()] == [
        (1, "Burger Barn", 0.8), (2, "Dear Sirs", 0.4), (3, None, 0.0)]


def test_no_job_runs_for_an_indexed_table(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id INT, text STRING")
    index = vendors.name_index(spark.createDataFrame([(n,) for n in NAMES], "name STRING"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        found = vendor_mentions(documents, index)
        assert not tracker.getJobIdsForGroup("planning")
        assert {r.doc_id: r.vendor for r in found.collect()} == EXPECTED
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stream_with_names_equals_batch(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id INT, text STRING")
    index = vendors.name_index(spark.createDataFrame([(n,) for n in NAMES], "name STRING"))
    for half in (documents.filter("doc_id < 4"), documents.filter("doc_id >= 4")):
        half.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(documents.schema).parquet(folder)
        extract_stream_with_names(stream, index, out, mark).awaitTermination()
    batch = with_vendor_table(extract_documents(documents), documents, index)
    stored = spark.read.parquet(out).drop("batch_id")
    assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect()))
