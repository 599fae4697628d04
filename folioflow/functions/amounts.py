"""Total amount: candidates, proximity score, best candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import SPACE, as_column, before, bind, from_first_cue, matches_near, preceded_by

# Cue words, window, scores, currency default, number shapes.
TOTAL_KEYWORDS = ("total", "grand total", "amount due", "balance due")
AMOUNT_WINDOW = 40
NEAR_SCORE = 0.9
PLAIN_SCORE = 0.5
SUBTOTAL_SCORE = 0.3
SMALLEST_AMOUNT = 0.01
CURRENCY = "USD"
AMOUNT_PREFIX = f"[$€£₹]?{SPACE}?"
GROUPED_NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?"
PLAIN_NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]{2})?"


def amount_candidates(
    text: Column | str,
    keywords: Sequence[str] = TOTAL_KEYWORDS,
    window: int = AMOUNT_WINDOW,
    plain_digits: bool = False,
    penalise_subtotal: bool = False,
) -> Column:
    """``array<struct<score, value>>`` of the amounts in text order.

    A number longer than three digits needs thousands separators unless ``plain_digits``.
    A subtotal line counts as a total line unless ``penalise_subtotal``.
    """
    number = PLAIN_NUMBER if plain_digits else GROUPED_NUMBER
    # The window ends at the symbol or blank before the number, which starts the match.
    cues = {"near": preceded_by(keywords, window, AMOUNT_PREFIX)}
    if penalise_subtotal:
        cues["near"] = preceded_by(keywords, window, AMOUNT_PREFIX, unless_after="sub")
        cues["subtotal"] = preceded_by(["subtotal"], window, AMOUNT_PREFIX)
    found = matches_near(text, number, "[0-9]", **cues)

    def score(hit: Column) -> Column:
        points = F.when(hit["near"] != "", NEAR_SCORE)
        if penalise_subtotal:
            points = points.when(hit["subtotal"] != "", SUBTOTAL_SCORE)
        return points.otherwise(PLAIN_SCORE)

    scored = F.transform(
        found,
        lambda hit: F.struct(
            score(hit).alias("score"),
            F.replace(hit["value"], F.lit(","), F.lit("")).try_cast("double").alias("value"),
        ),
    )
    return F.filter(scored, lambda c: c["value"] >= SMALLEST_AMOUNT)


def _largest_plain(text: Column, plain_digits: bool) -> Column:
    """The largest amount of a text without cues as a candidate, null without one."""
    number = PLAIN_NUMBER if plain_digits else GROUPED_NUMBER
    values = F.transform(
        F.regexp_extract_all(text, F.lit(f"({number})"), F.lit(1)),
        lambda value: F.replace(value, F.lit(","), F.lit("")).try_cast("double"),
    )
    return bind(
        F.array_max(values),
        lambda value: F.when(
            value >= SMALLEST_AMOUNT,
            F.struct(F.lit(PLAIN_SCORE).alias("score"), value.alias("value")),
        ),
    )


def total_amount(
    text: Column | str,
    currency: str = CURRENCY,
    keywords: Sequence[str] = TOTAL_KEYWORDS,
    window: int = AMOUNT_WINDOW,
    plain_digits: bool = False,
    penalise_subtotal: bool = False,
) -> Column:
    """``struct<value, currency, confidence>``: highest score, then largest value.

    What stands before the first keyword is searched only if no amount after it is near one.
    """
    text = as_column(text)
    options = (keywords, window, plain_digits, penalise_subtotal)
    guard = "sub" if penalise_subtotal else ""
    rest = from_first_cue(text, (*keywords, *(["subtotal"] if guard else [])), guard)
    if rest is None:
        best = F.array_max(amount_candidates(text, *options))
    else:

        def of_both(tail: Column) -> Column:
            def larger(late: Column) -> Column:
                plain = _largest_plain(before(text, tail), plain_digits)
                return F.when(late["score"] == NEAR_SCORE, late).otherwise(
                    F.array_max(F.array(late, plain))
                )

            return bind(F.array_max(amount_candidates(tail, *options)), larger)

        best = bind(rest, of_both)
    return bind(
        best,
        lambda found: F.struct(
            found["value"].alias("value"),
            F.when(found.isNotNull(), currency).alias("currency"),
            F.coalesce(found["score"], F.lit(0.0)).alias("confidence"),
        ),
    )
