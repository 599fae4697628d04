"""Invoice date: candidates, parsing, proximity score, best candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import SPACE, as_column, before, bind, from_first_cue, matches_near, preceded_by

# Cue words, how far left of a date they may stand, scores, date shapes.
DATE_KEYWORDS = ("invoice date", "date:", "dated:", "bill date")
DATE_WINDOW = 20
NEAR_SCORE = 0.9
PLAIN_SCORE = 0.5
DATE_SHAPES = (
    r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}",
    r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}",
    rf"[A-Za-z]{{3}}(?![!-~]){SPACE}[0-9]{{1,2}},{SPACE}[0-9]{{4}}",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_date(raw: Column, century_pivot: int = 69) -> Column:
    """Date of one candidate, null when it is none.

    Month first, then day first when the leading number exceeds 12. Two-digit years below
    ``century_pivot`` fall in 2000-2099, the others in 1900-1999.
    """

    def numeric(parts: Column) -> Column:
        first, second, third = parts[0], parts[1], parts[2]
        year_first = F.length(first) == 4
        day_first = first.try_cast("int") > 12
        century = F.when(third.try_cast("int") < century_pivot, "20").otherwise("19")
        year = (
            F.when(year_first, first)
            .when(F.length(third) == 4, third)
            .when(F.length(third) == 2, F.concat(century, third))
        )
        month = F.when(year_first | day_first, second).otherwise(first)
        day = F.when(year_first, third).when(day_first, first).otherwise(second)
        return F.when(year != "0000", F.concat_ws("-", year, month, day)).try_cast("date")

    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.array_position(months, F.lower(F.left(raw, F.lit(3)))).cast("string")
    day, year = F.regexp_extract(raw, "[0-9]+", 0), F.right(raw, F.lit(4))
    named = F.when(year != "0000", F.concat_ws("-", year, month, day)).try_cast("date")
    return F.when(raw.rlike("^[A-Za-z]"), named).otherwise(
        bind(F.split(F.translate(raw, "-", "/"), "/"), numeric)
    )


def _shapes() -> str:
    """One of the shapes; those in numbers are tried at digits only."""
    numeric = "|".join(shape for shape in DATE_SHAPES if shape.startswith("[0-9]"))
    named = "|".join(shape for shape in DATE_SHAPES if not shape.startswith("[0-9]"))
    return f"(?:(?=[0-9])(?:{numeric})|{named})"


# Every shape has a digit before a separator or comma.
_NEEDS = "[0-9][/,-]"


def date_candidates(
    text: Column | str,
    keywords: Sequence[str] = DATE_KEYWORDS,
    window: int = DATE_WINDOW,
    century_pivot: int = 69,
) -> Column:
    """``array<struct<score, position, value>>`` of the parseable candidates in text order."""
    found = matches_near(
        text, _shapes(), _shapes(), needs=_NEEDS, near=preceded_by(keywords, window)
    )
    scored = F.transform(
        found,
        lambda hit, position: F.struct(
            F.when(hit["near"] != "", NEAR_SCORE).otherwise(PLAIN_SCORE).alias("score"),
            position.alias("position"),
            parse_date(hit["value"], century_pivot).alias("value"),
        ),
    )
    return F.filter(scored, lambda c: c["value"].isNotNull())


def _first_date(text: Column, century_pivot: int) -> Column:
    """Date of the first parseable candidate, null without one."""
    found = matches_near(text, _shapes(), _shapes(), needs=_NEEDS)
    dates = F.transform(found, lambda hit: parse_date(hit["value"], century_pivot))
    return F.get(F.filter(dates, lambda value: value.isNotNull()), F.lit(0))


def _best(candidates: Column) -> Column:
    """``struct<value, score>`` of the first candidate with the highest score, null without one."""
    ranked = F.transform(
        candidates,
        lambda c: F.struct((-c["score"]).alias("rank"), c["position"], c["value"]),
    )
    return bind(
        F.array_min(ranked),
        lambda best: F.when(
            best.isNotNull(), F.struct(best["value"].alias("value"), (-best["rank"]).alias("score"))
        ),
    )


def invoice_date(
    text: Column | str,
    keywords: Sequence[str] = DATE_KEYWORDS,
    window: int = DATE_WINDOW,
    century_pivot: int = 69,
) -> Column:
    """``struct<value: date, confidence>``: the first candidate with the highest score.

    What stands before the first keyword is searched only if no date after it is near one.
    """
    text = as_column(text)
    rest = from_first_cue(text, keywords)
    if rest is None:
        best = _best(date_candidates(text, keywords, window, century_pivot))
    else:

        def of_both(tail: Column) -> Column:
            def earlier(late: Column) -> Column:
                first = bind(
                    _first_date(before(text, tail), century_pivot),
                    lambda value: F.when(
                        value.isNotNull(),
                        F.struct(value.alias("value"), F.lit(PLAIN_SCORE).alias("score")),
                    ),
                )
                return F.when(late["score"] == NEAR_SCORE, late).otherwise(F.coalesce(first, late))

            return bind(_best(date_candidates(tail, keywords, window, century_pivot)), earlier)

        best = bind(rest, of_both)
    return bind(
        best,
        lambda found: F.struct(
            found["value"].alias("value"),
            F.coalesce(found["score"], F.lit(0.0)).alias("confidence"),
        ),
    )
