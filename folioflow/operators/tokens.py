"""From OCR tokens to reading-order page text and document text.

A token row carries ``doc_id, page, engine, seq, text, confidence, bbox``; ``seq`` is the
position in which the engine reported it. Pages count from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.geometry import integer_polygon, rectangle_polygon
from folioflow.functions.reading import tokens_text
from folioflow.functions.strings import strip
from folioflow.schemas import TOKEN

from .joins import key_bits, lookup_join, possible_keys

# Engine names, page cap.
PRIMARY_ENGINE = "easyocr"
FALLBACK_ENGINE = "tesseract_fallback"
MAX_PAGES = 5
PAGE_KEY = ("doc_id", "page")


def usable_tokens(raw: DataFrame) -> DataFrame:
    """Tokens of a rectangle-reporting engine: ``text, conf (0-100), left, top, width, height``.

    Keeps whole-number confidence above 0 and text that is not blank; strips the text, scales
    the confidence to 0-1 and turns the rectangle into a polygon. Other columns pass through.
    """
    stripped = strip("text")
    return (
        raw.filter((F.col("conf") >= 1) & ~F.isnan("conf") & (stripped != ""))
        .withColumn("text", stripped)
        .withColumn("confidence", F.col("conf") / F.lit(100.0))
        .withColumn("bbox", rectangle_polygon("left", "top", "width", "height"))
        .drop("conf", "left", "top", "width", "height")
    )


def polygon_tokens(raw: DataFrame) -> DataFrame:
    """Tokens of a polygon-reporting engine: corner points truncated to whole pixels."""
    return raw.withColumn("bbox", integer_polygon("bbox"))


def token_rows(results: DataFrame, keys: Sequence[str] = PAGE_KEY) -> DataFrame:
    """A row per token from per-page results with an array ``tokens``, ``seq`` by position."""
    return results.select(*keys, "engine", F.posexplode("tokens").alias("seq", "_token")).select(
        *keys, "engine", "seq", "_token.*"
    )


def cap_pages(
    df: DataFrame, max_pages: int | None = MAX_PAGES, page: str = "page"
) -> DataFrame:
    """The first pages of every document, all for None; apply before anything costly."""
    return df if max_pages is None else df.filter(F.col(page) < max_pages)


def engine_fallback(
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str] = PAGE_KEY,
    engine: str = FALLBACK_ENGINE,
) -> DataFrame:
    """Primary tokens, plus the secondary tokens of pages where primary has none.

    A task holds the keys of its pages, not their tokens.
    """
    served = primary.select(*keys).distinct()
    rescued = lookup_join(secondary, served, list(keys), "left_anti", hashed=True)
    return primary.unionByName(rescued.withColumn("engine", F.lit(engine)))


def _packed() -> Column:
    """Token as it travels: the coordinates of four corners by axis, other outlines whole.

    A struct for each corner would take twice the room, in every shuffle and sort.
    """
    box = F.col("bbox")
    plain = F.size(box) == 4
    for place in range(4):
        plain = plain & F.get(box, F.lit(place)).isNotNull()
    return F.struct(
        "seq", "text", "confidence",
        F.when(plain, box["x"]).alias("xs"),
        F.when(plain, box["y"]).alias("ys"),
        F.when(~F.coalesce(plain, F.lit(False)), box).alias("outline"),
    )


def _unpacked(packed: Column) -> Column:
    """The token with its place in reading order before it: top-left y, x, reported position."""
    corners = F.arrays_zip(packed["xs"].alias("x"), packed["ys"].alias("y"))
    x, y = (F.get(packed[axis], F.lit(0)) for axis in ("xs", "ys"))
    other = F.get(packed["outline"], F.lit(0))
    return F.struct(
        F.coalesce(y, other["y"]).alias("y"), F.coalesce(x, other["x"]).alias("x"),
        packed["seq"].alias("seq"),
        F.struct(
            packed["text"].alias("text"), packed["confidence"].alias("confidence"),
            F.coalesce(corners, packed["outline"]).alias("bbox"),
        ).alias("token"),
    )


def _in_reading_order(unpacked: Column) -> Column:
    """The tokens of a page, sorted by their places."""
    return F.sort_array(unpacked)["token"]


def read_pages(
    tokens: DataFrame, keys: Sequence[str] = PAGE_KEY, tasks: int | None = None
) -> DataFrame:
    """One row per page: ``tokens`` in reading order and ``full_text`` joined by blanks.

    Lists of many pages do not fit the memory of a task and are sorted by page, before the
    shuffle and after it. For large inputs ``tasks`` deals the tokens over so many tasks first,
    so that they are sorted in small parts only, which need no disk.
    """
    rows, found = tokens.select(*keys, "engine", _packed().alias("_token")), F.col("_found")
    if tasks:
        # Unpacked row by row where tokens arrive, which takes less time than list by list.
        rows = rows.repartition(tasks, *keys).withColumn("_token", _unpacked(F.col("_token")))
    else:
        found = F.transform(found, _unpacked)
    return (
        rows.groupBy(*keys)
        .agg(F.min("engine").alias("engine"), F.collect_list("_token").alias("_found"))
        .withColumn("tokens", _in_reading_order(found))
        .select(*keys, "engine", "tokens", tokens_text("tokens").alias("full_text"))
    )


def _unserved(
    pages: DataFrame, primary: DataFrame, secondary: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Secondary tokens but for most of the pages that primary has read, left out in place.

    All tokens of listed pages without primary ones stay; only keys of pages are shuffled.
    """
    listed, read = pages.select(*keys), primary.select(*keys)
    # Equal keys have one hash in one type only.
    common = listed.unionByName(read).unionByName(secondary.select(*keys)).schema
    same = {key: F.col(key).cast(common[key].dataType) for key in keys}
    wanted = listed.withColumns(same).join(read.withColumns(same).distinct(), list(keys), "left_anti")
    return possible_keys(secondary.withColumns(same), key_bits(wanted, *keys), *keys)


def read_pages_with_fallback(
    pages: DataFrame,
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str] = PAGE_KEY,
    primary_engine: str = PRIMARY_ENGINE,
    fallback_engine: str = FALLBACK_ENGINE,
    together: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Reading order and engine fallback for every listed page in one shuffle.

    A page without primary tokens is labelled as fallback even when the secondary engine
    found nothing either. Tokens of unlisted pages are ignored. ``together`` names the keys
    to partition by when a later step groups by fewer of them; by default pages spread freely.

    For large inputs ``tasks`` deals the tokens over so many tasks. Then the keys of the primary
    tokens are read first, and secondary tokens of pages that primary has read are not shuffled,
    but for a few that bits cannot tell: one page in a hundred where a million lack tokens.
    """

    def tagged(tokens: DataFrame, rank: int) -> DataFrame:
        return tokens.select(*keys, F.lit(rank).alias("_rank"), _packed().alias("_entry"))

    if tasks:
        secondary = _unserved(pages, primary, secondary, keys)
    entry = primary.select(_packed().alias("e")).schema["e"].dataType
    listed = pages.select(
        *keys, F.lit(0).alias("_rank"), F.lit(None).cast(entry).alias("_entry")
    )
    rows = listed.unionByName(tagged(primary, 1)).unionByName(tagged(secondary, 2))
    served = F.size("_primary") > 0
    found = F.when(served, F.col("_primary")).otherwise(F.col("_secondary"))
    if together:
        parts = [tasks] if tasks else []
        # As in read_pages, unpacked where tokens arrive.
        rows = rows.repartition(*parts, *together)
        rows = rows.withColumn("_entry", _unpacked(F.col("_entry")))
    else:
        found = F.transform(found, _unpacked)
    grouped = (
        rows.groupBy(*keys)
        .agg(
            F.max(F.col("_rank") == 0).alias("_listed"),
            F.collect_list(F.when(F.col("_rank") == 1, F.col("_entry"))).alias("_primary"),
            F.collect_list(F.when(F.col("_rank") == 2, F.col("_entry"))).alias("_secondary"),
        )
        .filter("_listed")
    )
    return (
        grouped.withColumn("tokens", _in_reading_order(found))
        .withColumn("engine", F.when(served, primary_engine).otherwise(fallback_engine))
        .select(*keys, "engine", "tokens", tokens_text("tokens").alias("full_text"))
    )


def assemble_documents(pages: DataFrame, doc_id: str = "doc_id", page: str = "page") -> DataFrame:
    """One row per document: page texts joined by newlines, tokens concatenated.

    ``engine`` is that of the first page. A document is one output row, so its pages meet in
    one task by definition; cap pages first.
    """
    has_tokens = "tokens" in pages.columns
    parts = ["engine", "full_text"] + (["tokens"] if has_tokens else [])
    ordered = F.sort_array(F.collect_list(F.struct(page, *parts))).alias("_pages")
    tokens = F.flatten(F.transform("_pages", lambda p: p["tokens"])) if has_tokens else F.lit(
        None
    ).cast(f"ARRAY<{TOKEN}>")
    return (
        pages.groupBy(doc_id)
        .agg(ordered)
        .select(
            doc_id,
            F.array_join(F.transform("_pages", lambda p: p["full_text"]), "\n").alias("text"),
            tokens.alias("tokens"),
            F.size("_pages").alias("pages"),
            F.col("_pages")[0]["engine"].alias("engine"),
        )
    )
