"""Short extractive summary: sentences with digits first, then the leading others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column, bind, strip

# Sentence breaks, length floor, bullet limit, message for texts without any.
SENTENCE_BREAK = r"[.!?\n]+"
LONGER_THAN = 20
BULLETS = 3
NO_SUMMARY = "No text content sufficiently long to summarize."


def summarize(text: Column | str, bullets: int = BULLETS, longer_than: int = LONGER_THAN) -> Column:
    """``array<string>`` of at most ``bullets`` sentences, or the fixed message."""
    sentences = F.filter(
        F.transform(F.split(F.coalesce(as_column(text), F.lit("")), SENTENCE_BREAK), strip),
        lambda sentence: F.char_length(sentence) > longer_than,
    )

    def pick(kept: Column) -> Column:
        with_digit = F.filter(kept, lambda s: s.rlike(r"\p{Nd}"))
        without = F.filter(kept, lambda s: ~s.rlike(r"\p{Nd}"))
        return F.when(F.size(kept) == 0, F.array(F.lit(NO_SUMMARY))).otherwise(
            bind(
                with_digit,
                lambda numbers: F.when(F.size(numbers) >= bullets, F.slice(numbers, 1, bullets))
                .otherwise(F.slice(F.concat(numbers, without), 1, bullets)),
            )
        )

    return bind(sentences, pick)
