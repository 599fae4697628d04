"""Boxes, polygons and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import as_column

# Fixed value: the first two coordinates of a piece with a comma.
_PIECE = "(?:^|;)([^,;]*),([^,;]*)"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def integer_polygon(bbox: Column | str) -> Column:
    """Corner points truncated to whole pixels."""
    return F.transform(
        as_column(bbox), lambda p: point(p["x"].cast("int"), p["y"].cast("int"))
    )


def rectangle_polygon(left, top, width, height) -> Column:
    """Corners of a rectangle: top-left, top-right, bottom-right, bottom-left."""
    left, top, width, height = map(as_column, (left, top, width, height))
    right, bottom = left + width, top + height
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(
        x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max")
    )


def box_width(bbox: Column | str) -> Column:
    bbox = as_column(bbox)
    return bbox["x_max"] - bbox["x_min"]


def box_height(bbox: Column | str) -> Column:
    bbox = as_column(bbox)
    return bbox["y_max"] - bbox["y_min"]


def bounding_box(points: Column) -> Column:
    """Smallest box around ``array<struct<x, y>>``; null below two points."""
    xs, ys = points["x"], points["y"]
    return F.when(
        F.size(points) >= 2,
        box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )


def points_from_text(raw: Column | str) -> Column:
    """``'x,y;x,y'`` as points; pieces without a comma are dropped.

    A coordinate that is no number is null, see ``half_read``.
    """

    def coordinates(place: int) -> Column:
        texts = F.regexp_extract_all(as_column(raw), F.lit(_PIECE), F.lit(place))
        return texts.try_cast("array<double>")

    return F.arrays_zip(coordinates(1).alias("x"), coordinates(2).alias("y"))


def half_read(points: Column) -> Column:
    """Whether a point lacks a coordinate."""

    def lacking(coordinates: Column) -> Column:
        # Sorting puts nulls first and is compiled, other than lambda functions.
        return (F.size(coordinates) > 0) & F.get(F.sort_array(coordinates), F.lit(0)).isNull()

    return lacking(points["x"]) | lacking(points["y"])


def percent_to_pixel(percent: Column, size: Column) -> Column:
    return percent / F.lit(100.0) * size


def box_from_centre(x, y, width, height, image_width, image_height) -> Column:
    """Centre-and-size box scaled by the image size (1 x 1 keeps it normalised)."""
    half_w, half_h = width / F.lit(2.0), height / F.lit(2.0)
    return box(
        (x - half_w) * image_width,
        (y - half_h) * image_height,
        (x + half_w) * image_width,
        (y + half_h) * image_height,
    )
