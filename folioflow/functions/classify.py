"""Document type from keyword counts."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column

# The keyword sets, in the order they are documented.
INVOICE_KEYWORDS = ("invoice", "bill to", "due date", "invoice number", "inv#")
RECEIPT_KEYWORDS = ("receipt", "ticket", "change due", "cash", "terminal", "pos")


def keyword_score(
    text: Column | str, keywords: Sequence[str], word_boundary: bool = False
) -> Column:
    """Number of distinct keywords present in the lower-cased text.

    By default a keyword counts wherever it occurs, also inside a longer word;
    ``word_boundary=True`` asks for whole words.
    """
    lowered = F.lower(as_column(text))

    def present(keyword: str) -> Column:
        if word_boundary:
            return lowered.rlike(rf"(?<![a-z0-9]){re.escape(keyword)}(?![a-z0-9])")
        return F.contains(lowered, F.lit(keyword))

    hits = [F.coalesce(present(k).cast("int"), F.lit(0)) for k in keywords]
    return functools.reduce(operator.add, hits, F.lit(0))


def classify(
    text: Column | str,
    invoice_keywords: Sequence[str] = INVOICE_KEYWORDS,
    receipt_keywords: Sequence[str] = RECEIPT_KEYWORDS,
    word_boundary: bool = False,
) -> Column:
    """``struct<doc_type, confidence>``; a tie with hits goes to invoice at 0.5."""
    invoice = keyword_score(text, invoice_keywords, word_boundary)
    receipt = keyword_score(text, receipt_keywords, word_boundary)

    def confidence(score: Column) -> Column:
        return F.least(F.lit(0.5) + score * F.lit(0.1), F.lit(0.99))

    return F.struct(
        F.when(invoice > receipt, "invoice")
        .when(receipt > invoice, "receipt")
        .when(invoice > 0, "invoice")
        .otherwise("unknown")
        .alias("doc_type"),
        F.when(invoice > receipt, confidence(invoice))
        .when(receipt > invoice, confidence(receipt))
        .when(invoice > 0, F.lit(0.5))
        .otherwise(F.lit(0.0))
        .alias("confidence"),
    )
