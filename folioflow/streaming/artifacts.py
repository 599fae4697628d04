"""Artifacts of documents that arrive as a stream, one version of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.columns import settle
from folioflow.operators.joins import first_per_key
from folioflow.plans.extract import documents_from_page_arrays, extract_documents
from folioflow.schemas import TOKEN

from .upserts import BUCKETS, current_rows, upsert

DOCUMENTS = (
    "doc_id STRING, arrived BIGINT,"
    f" pages ARRAY<STRUCT<page: INT, engine: STRING, tokens: ARRAY<{TOKEN}>>>"
)


def latest_documents(batch: DataFrame) -> DataFrame:
    """Of each document of a batch the row that arrived last (``arrived``, then its pages)."""
    backwards = batch.withColumn("_order", -F.col("arrived"))
    return first_per_key(backwards, ["doc_id"], ["_order", "pages"]).drop("_order")


def page_rows(documents: DataFrame) -> DataFrame:
    """``doc_id, page, engine, tokens`` of every page; a document without pages has one null row.

    That row replaces the pages of an earlier version.
    """
    return documents.select("doc_id", F.inline_outer("pages"))


def keep_artifacts(
    documents: DataFrame,
    root: str,
    checkpoint: str,
    known_vendor: Column | None = None,
    buckets: int = BUCKETS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start keeping ``<root>/extractions`` and ``<root>/pages`` of arriving documents.

    ``documents``: DOCUMENTS. A document that arrives again, in one batch or another, leaves its
    last arrival only, and a batch that runs again changes nothing, see ``upserts``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest = latest_documents(batch)
        texts = documents_from_page_arrays(latest)
        extracted = extract_documents(settle_text(texts), known_vendor=known_vendor)
        upsert(extracted, batch_id, f"{root}/extractions", ["doc_id"], buckets)
        upsert(page_rows(latest), batch_id, f"{root}/pages", ["doc_id"], buckets)

    return (
        documents.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def settle_text(documents: DataFrame) -> DataFrame:
    """The documents with their text computed once."""
    kept = [c for c in documents.columns if c != "text"]
    return settle(documents.withColumnRenamed("text", "_text"), text=F.col("_text")).select(
        *kept, "text"
    )


def stored_extractions(spark: SparkSession, root: str) -> DataFrame:
    """The extraction of every document, as last written."""
    empty = spark.createDataFrame([], DOCUMENTS)
    schema = extract_documents(documents_from_page_arrays(empty)).schema
    return current_rows(spark, f"{root}/extractions", schema)


def stored_pages(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, page, engine, tokens`` of every document's pages, as last written."""
    schema: T.StructType = page_rows(spark.createDataFrame([], DOCUMENTS)).schema
    return current_rows(spark, f"{root}/pages", schema).filter("page IS NOT NULL")
