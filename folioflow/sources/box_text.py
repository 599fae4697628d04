"""Normalised-box text files: one file per image, one ``class x y width height`` per line."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.geometry import box_from_centre
from folioflow.functions.strings import SPACE, strip
from folioflow.operators.columns import settle

from .listing import list_tree, text_lines
from .annotations import attach_image_size, attributes, name_classes, order_key, record

TOOL = "roboflow"
_NUMBERS = ("_x", "_y", "_w", "_h")


def _numbers(lines: DataFrame) -> DataFrame:
    """The lines with ``class_id`` and numbers, ``_listed`` with five fields, ``_readable``.

    Further fields are ignored.
    """
    # Generators keep what is filtered by where it is: a filter on the parsed numbers would be
    # moved below earlier shuffles and parse every line a second time.
    split = settle(lines, _fields=F.split(strip("value"), f"{SPACE}+"))
    class_id = F.get("_fields", F.lit(0)).try_cast("int")
    numbers = [F.get("_fields", F.lit(i)).try_cast("double") for i in range(1, 5)]
    parsed = settle(split, class_id=class_id, **dict(zip(_NUMBERS, numbers)))
    readable = functools.reduce(
        operator.and_, [F.col(n).isNotNull() for n in ("class_id", *_NUMBERS)]
    )
    return parsed.withColumns({"_readable": readable, "_listed": F.size("_fields") >= 5})


def box_records(
    lines: DataFrame,
    classes: Mapping[int, str] | DataFrame | None = None,
    images: DataFrame | None = None,
) -> DataFrame:
    """Records of ``stem, value`` lines; in pixels where ``images`` knows the size of a stem."""
    parsed = _numbers(lines.select("stem", "value")).filter("_readable").select(
        "stem", "class_id", *_NUMBERS
    )
    sized = attach_image_size(name_classes(parsed, classes), images)
    attrs = attributes(
        {"class_id": F.col("class_id"), "normalised": F.lit(images is None)}
    )
    bbox = box_from_centre(
        *[F.col(n) for n in _NUMBERS], F.col("image_width"), F.col("image_height")
    )
    return sized.select(
        *record(
            F.col("image_path"), F.col("label"), bbox, TOOL, attrs,
            order_key(F.col("stem"), F.lit(None), F.lit(0), F.lit(None)),
        )
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines with enough fields whose numbers cannot be read."""
    return _numbers(lines).filter("_listed AND NOT _readable").select(*lines.columns)


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    """``stem, value`` of the .txt files in a directory, sub-directories not included.

    Names that begin with ``_`` or ``.`` count like others.
    """
    files = list_tree(spark, directory, recursive=False).filter("path LIKE '%.txt'")
    # For every line again, so without a pattern that is tried at each character of the path.
    name = F.substring_index("path", "/", -1)
    stem = F.left(name, F.char_length(name) - F.lit(len(".txt")))
    return text_lines(files).select(stem.alias("stem"), "value")


def load_box_text(
    spark: SparkSession,
    directory: str,
    classes: Mapping[int, str] | DataFrame | None = None,
    images: DataFrame | None = None,
) -> DataFrame:
    """Records of a folder of label files."""
    return box_records(read_lines(spark, directory), classes, images)
