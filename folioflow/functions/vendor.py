"""Vendor name: known-name lookup in the head of the text, else the first real line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import WHITESPACE_CLASS, as_column

# How much text the name lookup sees, line length floor, confidences.
HEAD_CHARS = 500
LONGER_THAN = 3
KNOWN_CONFIDENCE = 0.8
LINE_CONFIDENCE = 0.4

# What is trimmed from words, the same as \p{Punct}.
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def name_words(text: Column | str) -> Column:
    """Lower-cased words without the punctuation around them."""
    words = F.split(F.lower(as_column(text)), f"[{WHITESPACE_CLASS}]+")
    bare = F.transform(words, lambda word: F.btrim(word, F.lit(_EDGE)))
    return F.filter(bare, lambda word: word != "")


def normalised_name(name: Column | str) -> Column:
    """A name in the form mentions are compared in: its words joined by one blank."""
    return F.array_join(name_words(name), " ")


def text_head(text: Column | str, head_chars: int = HEAD_CHARS) -> Column:
    """The first characters of a text, without a word that goes on beyond them."""
    text = as_column(text)
    cut = F.regexp_replace(
        F.substring(text, 1, head_chars + 1), f"[^{WHITESPACE_CLASS}]*$", ""
    )
    return F.when(F.char_length(text) > head_chars, cut).otherwise(text)


def first_line(text: Column | str, longer_than: int = LONGER_THAN) -> Column:
    """First newline-separated line whose stripped length exceeds ``longer_than``."""
    blank = f"[{WHITESPACE_CLASS}&&[^\\n]]"
    solid = f"[^{WHITESPACE_CLASS}]"
    body = rf"{solid}[^\n]{{{longer_than - 1},}}{solid}"
    found = F.regexp_extract(as_column(text), rf"(?md)^{blank}*+({body}){blank}*$", 1)
    return F.nullif(found, F.lit(""))


def known_name(text: Column | str, names: Sequence[str], head_chars: int = HEAD_CHARS) -> Column:
    """Earliest of the literal names in the head of the text, longest at equal position.

    Map-only; for very many names, ``operators.vendors`` does the same with a table. The text is
    reduced to its words, so one regex over the joined words decides.
    """
    keyed = {" ".join(filter(None, map(_plain_word, name.lower().split()))): name
             for name in sorted(names, reverse=True)}
    keyed.pop("", None)
    if not keyed:
        return F.lit(None).cast("string")
    longest_first = sorted(keyed, key=lambda key: (-key.count(" "), key))
    pattern = "(?<![^ ])(?:" + "|".join(rf"\Q{key}\E" for key in longest_first) + ")(?![^ ])"
    head = normalised_name(text_head(text, head_chars))
    lookup = F.create_map(*[F.lit(part) for pair in keyed.items() for part in pair])
    return F.try_element_at(lookup, F.regexp_extract(head, pattern, 0))


def _plain_word(word: str) -> str:
    return word.strip(_EDGE)


def vendor(text: Column | str, known: Column | None = None) -> Column:
    """``struct<value, confidence>`` from a known name (0.8) or the first line (0.4)."""
    line = first_line(text)
    if known is None:
        known = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(known, line).alias("value"),
        F.when(known.isNotNull(), KNOWN_CONFIDENCE)
        .when(line.isNotNull(), LINE_CONFIDENCE)
        .otherwise(0.0)
        .alias("confidence"),
    )
