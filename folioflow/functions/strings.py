"""Whitespace, binding and proximity helpers shared by the text functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Unicode-aware stripping and \s remove.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body.
WHITESPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


_LETTERS = re.compile("[A-Za-z]{3}")

# The same set for Java regular expressions outside classes, faster than a list of ranges.
SPACE = r"(?U:[\s\x{1c}-\x{1f}])"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(as_column(text), F.lit(WHITESPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def preceded_by(
    keywords: Sequence[str], window: int, prefix: str = "", unless_after: str = ""
) -> str:
    """Regex fragment: some keyword lies wholly within the ``window`` characters to the left.

    ``prefix`` is what may stand between the window and the value without counting. The
    fragment captures one group, empty when no keyword is near; a keyword directly following
    ``unless_after`` does not count. A bounded look-behind reads the characters in place, so a
    hit costs O(window) wherever it is in the text; the look-ahead on first letters keeps it
    from trying every keyword at every character.
    """
    # A keyword that contains another one adds nothing.
    needed = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    needed = [k for k in needed if len(k) <= window]
    initials = "".join(sorted({rf"\x{{{ord(k[0]):x}}}" for k in needed}))
    guard = rf"(?<!\Q{unless_after}\E)" if unless_after else ""
    # Lazy, so that it stops at the value instead of running past it and back.
    contexts = "|".join(rf"\Q{k}\E(?s:.{{0,{window - len(k)}}}?)" for k in needed)
    return rf"(?:(?i:(?<=((?=[{initials}]){guard}(?:{contexts})){prefix})))?"


def from_first_cue(
    text: Column | str, keywords: Sequence[str], unless_after: str = ""
) -> Column | None:
    """The text from its first keyword on, empty without one; null stays null.

    Nothing before it is near a keyword, so that only the rest must be searched for cues. Each
    keyword must begin with three letters, which keeps values from lying across the cut: no
    value has a letter but for a named month, whose third letter a blank follows. For other
    keywords there is no such text, and the answer is None. ``unless_after`` stays with the
    keyword that follows it.
    """
    if not keywords or not all(_LETTERS.match(k) for k in (*keywords, unless_after or "abc")):
        return None
    kept = rf"(?:\Q{unless_after}\E)?" if unless_after else ""
    first = {k[0] for k in (*keywords, *unless_after[:1])}
    initials = "".join(sorted({c for k in first for c in (k.lower(), k.upper())}))
    opening = "|".join(rf"\Q{k}\E" for k in keywords)
    text = as_column(text)
    met = F.regexp_extract(text, rf"(?=[{initials}])(?i:{kept}(?:{opening}))", 0)
    # As it is written there, the keyword found first stands nowhere before.
    return bind(
        met,
        lambda keyword: F.when(keyword == "", keyword).otherwise(
            F.substr(text, F.char_length(_up_to(text, keyword)) + 1)
        ),
    )


def _up_to(text: Column, part: Column) -> Column:
    return F.call_function("substring_index", text, part, F.lit(1))


def before(text: Column | str, rest: Column) -> Column:
    """What stands before ``rest``, which the text ends with."""
    text = as_column(text)
    return F.substr(text, F.lit(1), F.char_length(text) - F.char_length(rest))


def matches_near(
    text: Column | str, value: str, starts: str, needs: str | None = None, **cues: str
) -> Column:
    """All non-overlapping matches of the regex ``value``, left to right.

    Returns ``array<struct<value, cue...>>``; each cue is a ``preceded_by`` fragment and its
    field is non-empty where it holds. ``starts`` is a cheap pattern that holds wherever a
    value starts, ``needs`` one found in every text with a value, which saves the scan of the
    others. None of them may hold a capturing group. The cues are optional and of zero width,
    so both scans stop at the same matches; texts without a match are scanned once.
    """
    text = as_column(text)
    cued = f"(?={starts}){''.join(cues.values())}{value}"
    # Java measures look-behinds in UTF-16 units, and in characters only when the pattern itself
    # holds one beyond the basic plane. The slower measure is for texts with such characters.
    astral = text.rlike(r"[\x{10000}-\x{10ffff}]")
    by_character = f"{cued}|(?!)\U00010000"
    values = F.regexp_extract_all(text, F.lit(f"({value})"), F.lit(1))
    if needs:
        values = F.when(text.rlike(needs), values).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    nothing = F.expr(
        "CAST(array() AS ARRAY<STRUCT<value: STRING"
        + "".join(f", {name}: STRING" for name in cues)
        + ">>)"
    )
    groups = [
        F.when(astral, F.regexp_extract_all(text, F.lit(by_character), F.lit(index)))
        .otherwise(F.regexp_extract_all(text, F.lit(cued), F.lit(index)))
        .alias(name)
        for index, name in enumerate(cues, start=1)
    ]
    return bind(
        values,
        lambda found: F.when(F.size(found) == 0, nothing).otherwise(
            F.arrays_zip(found.alias("value"), *groups)
        ),
    )
