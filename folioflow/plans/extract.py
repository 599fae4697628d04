"""The extraction flow: text or tokens to one structured row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.amounts import total_amount
from folioflow.functions.classify import classify
from folioflow.functions.dates import invoice_date
from folioflow.functions.reading import read_page_array
from folioflow.functions.strings import as_column
from folioflow.functions.summary import summarize
from folioflow.functions.vendor import KNOWN_CONFIDENCE, vendor
from folioflow.operators.tokens import (
    PRIMARY_ENGINE,
    assemble_documents,
    cap_pages,
    read_pages,
    read_pages_with_fallback,
)
from folioflow.operators.vendors import vendor_mentions


def extract_fields(text: Column | str, known_vendor: Column | None = None) -> Column:
    """``struct<vendor_name, invoice_date, total_amount>`` of value-and-confidence structs."""
    return F.struct(
        vendor(text, known_vendor).alias("vendor_name"),
        invoice_date(text).alias("invoice_date"),
        total_amount(text).alias("total_amount"),
    )


def extract_documents(
    documents: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    known_vendor: Column | None = None,
) -> DataFrame:
    """One response row per document. Map-only, so it runs on streams unchanged.

    ``engine`` and ``pages`` columns are used when present. ``known_vendor`` is an expression
    such as ``functions.vendor.known_name``; for a table of names see ``with_vendor_table``.
    """
    present = set(documents.columns)
    engine = F.col("engine") if "engine" in present else F.lit(PRIMARY_ENGINE)
    pages = F.col("pages") if "pages" in present else F.lit(1)
    return documents.select(
        doc_id,
        classify(text).alias("_type"),
        extract_fields(text, known_vendor).alias("fields"),
        summarize(text).alias("summary"),
        F.struct(
            engine.alias("ocr_engine"),
            pages.cast("int").alias("pages"),
            F.lit(None).cast("double").alias("processing_time_ms"),
        ).alias("debug"),
        F.expr("CAST(array() AS ARRAY<STRING>)").alias("errors"),
    ).select(
        doc_id,
        F.col("_type.doc_type").alias("doc_type"),
        F.col("_type.confidence").alias("classification_confidence"),
        "fields",
        "summary",
        "debug",
        "errors",
    )


def with_vendor_table(
    extracted: DataFrame,
    documents: DataFrame,
    names: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Replace the vendor where a known name is mentioned.

    Joins narrow tables only: the extracted rows and the mentions. The texts stay in place.
    """
    mentions = vendor_mentions(documents, names, doc_id, text)
    known = F.struct(F.col("_known").alias("value"), F.lit(KNOWN_CONFIDENCE).alias("confidence"))
    return (
        extracted.join(mentions.withColumnRenamed("vendor", "_known"), doc_id, "left")
        .withColumn(
            "fields",
            F.struct(
                F.when(F.col("_known").isNotNull(), known)
                .otherwise(F.col("fields.vendor_name"))
                .alias("vendor_name"),
                "fields.invoice_date",
                "fields.total_amount",
            ),
        )
        .drop("_known")
    )


def documents_from_tokens(
    primary: DataFrame,
    secondary: DataFrame | None = None,
    pages: DataFrame | None = None,
    max_pages: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Document texts from token tables, of all pages or the first ``max_pages``.

    ``pages`` lists the pages that exist; without it only pages with tokens are known. The
    documents are dealt over ``tasks`` tasks, by default as many as the session shuffles to.
    """
    parts = [tasks] if tasks else []
    primary = cap_pages(primary, max_pages)
    if secondary is None and pages is None:
        return assemble_documents(read_pages(primary.repartition(*parts, "doc_id")))
    secondary = primary.limit(0) if secondary is None else cap_pages(secondary, max_pages)
    if pages is None:
        pages = primary.select("doc_id", "page").unionByName(secondary.select("doc_id", "page"))
        pages = pages.distinct()
    # Partitioned by document once: page and document assembly both fit this partitioning.
    return assemble_documents(
        read_pages_with_fallback(
            cap_pages(pages, max_pages), primary, secondary, together=("doc_id",), tasks=tasks
        )
    )


def documents_from_page_arrays(rows: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Document texts from one row per document. Map-only, for streams as well.

    ``rows``: ``doc_id, pages ARRAY<STRUCT<page, engine, tokens>>``, tokens in reported order.
    """
    return rows.select("doc_id", read_page_array("pages", max_pages).alias("_read")).select(
        "doc_id", "_read.*"
    )


def flatten(extracted: DataFrame, *extra: str) -> DataFrame:
    """Field values and confidences as plain columns, ready for evaluation."""
    fields = F.col("fields")
    return extracted.select(
        *extra,
        fields["vendor_name"]["value"].alias("vendor"),
        fields["vendor_name"]["confidence"].alias("vendor_conf"),
        fields["invoice_date"]["value"].alias("date"),
        fields["invoice_date"]["confidence"].alias("date_conf"),
        fields["total_amount"]["value"].alias("amount"),
        fields["total_amount"]["confidence"].alias("amount_conf"),
        "doc_type",
    )


def predict_first_pages(pages: DataFrame, file_path: str = "file_path") -> DataFrame:
    """Flattened predictions from the first page of every file.

    ``pages``: ``file_path, page, text, preprocessing_ms, overhead_reduction_pct`` and
    optionally ``success``; a failed page keeps its row without values.
    """
    first = cap_pages(pages, 1)
    ok = F.coalesce("success", F.lit(False)) if "success" in pages.columns else F.lit(True)
    flat = first.select(
        file_path,
        "preprocessing_ms",
        "overhead_reduction_pct",
        ok.alias("success"),
        F.when(ok, as_column("text")).alias("text"),
    ).withColumn("fields", extract_fields("text")).withColumn("_type", classify("text"))
    values = flatten(
        flat.withColumn("doc_type", F.when(F.col("success"), F.col("_type.doc_type"))),
        file_path, "success", "preprocessing_ms", "overhead_reduction_pct",
    )
    return values
