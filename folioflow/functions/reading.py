"""Reading order and text of token arrays that are already in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column, bind


def in_reading_order(tokens: Column | str) -> Column:
    """Tokens by top-left y, then top-left x, otherwise in the given order."""
    keyed = F.transform(
        as_column(tokens),
        lambda token, position: F.struct(
            token["bbox"][0]["y"].alias("y"),
            token["bbox"][0]["x"].alias("x"),
            position.alias("position"),
            token.alias("token"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda entry: entry["token"])


def tokens_text(tokens: Column | str) -> Column:
    """Token texts joined by blanks, in array order."""
    return F.array_join(as_column(tokens)["text"], " ")


def read_page_array(pages: Column | str, max_pages: int | None = None) -> Column:
    """``struct<text, tokens, pages, engine>`` of ``array<struct<page, engine, tokens>>``.

    The first pages by number (all for None), each in reading order, their texts joined by newlines.
    """
    kept = as_column(pages)
    if max_pages is not None:
        kept = F.filter(kept, lambda p: p["page"] < max_pages)
    ordered = F.transform(
        F.sort_array(kept),
        lambda p: F.struct(
            p["engine"].alias("engine"), in_reading_order(p["tokens"]).alias("tokens")
        ),
    )
    return bind(
        ordered,
        lambda read: F.struct(
            F.array_join(F.transform(read, lambda p: tokens_text(p["tokens"])), "\n").alias("text"),
            F.flatten(F.transform(read, lambda p: p["tokens"])).alias("tokens"),
            F.size(read).alias("pages"),
            F.get(read, F.lit(0))["engine"].alias("engine"),
        ),
    )
