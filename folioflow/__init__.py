"""Structured records from OCR tokens and page text, as Spark DataFrame operators."""
