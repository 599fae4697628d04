"""Schemas of the tables the operators read and write."""

POINT = "STRUCT<x: INT, y: INT>"
TOKEN = f"STRUCT<text: STRING, confidence: DOUBLE, bbox: ARRAY<{POINT}>>"
TOKENS_TABLE = (
    "doc_id STRING, page INT, engine STRING, seq INT, text STRING, confidence DOUBLE, "
    f"bbox ARRAY<{POINT}>"
)
BOX = "STRUCT<x_min: DOUBLE, y_min: DOUBLE, x_max: DOUBLE, y_max: DOUBLE>"
# Where a record stood in its export: file, item, section of the item, place, part of a place.
ORDER_KEY = "STRUCT<file: STRING, item: BIGINT, section: INT, place: INT, part: INT>"
ANNOTATION = (
    f"image_path STRING, label STRING, bbox {BOX}, source_tool STRING, "
    f"attributes MAP<STRING, STRING>, order_key {ORDER_KEY}"
)
LABELS = (
    "doc_id STRING, file_path STRING, vendor_name STRING, invoice_date DATE, "
    "total_amount DOUBLE, doc_type STRING"
)
LATENCY = "ts TIMESTAMP, method STRING, path STRING, elapsed_ms DOUBLE"
ARCHIVE_MEMBERS = (
    "archive STRING, member_index INT, member STRING, content BINARY, error STRING"
)
