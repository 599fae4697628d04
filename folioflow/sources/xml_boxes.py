"""Annotation exports in XML: boxes, polygons and polylines of images, boxes of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.geometry import bounding_box, box, half_read, points_from_text
from folioflow.operators.columns import settle

from .annotations import (
    UNKNOWN,
    attributes,
    merge_annotations,
    number,
    order_key,
    readable,
    record,
    rejected,
    unreadable,
)

TOOL = "cvat"
CORNERS = ("_xtl", "_ytl", "_xbr", "_ybr")
SIZES = ("_width", "_height")
# Numbers are read as texts, which tell an absent one from an unreadable one.
_CORNERS = ", ".join(f"{c}: STRING" for c in CORNERS)
_SHAPE = "ARRAY<STRUCT<_label: STRING, _points: STRING>>"
_BOX = (
    f"STRUCT<_label: STRING, _occluded: STRING, {_CORNERS}, "
    "attribute: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>"
)
IMAGE_ELEMENT = (
    "_id BIGINT, _name STRING, _width STRING, _height STRING, "
    f"box ARRAY<{_BOX}>, polygon {_SHAPE}, polyline {_SHAPE}"
)
TRACK_ELEMENT = (
    "_id BIGINT, _label STRING, _source STRING, "
    f"box ARRAY<STRUCT<_frame: STRING, {_CORNERS}>>"
)


def _corner_box(shape: Column) -> Column:
    return box(*[number(shape[n]) for n in CORNERS])


def _named(shape: Column) -> dict[str, Column]:
    return {n[1:]: shape[n] for n in CORNERS}


def _box_attributes(b: Column, width: Column, height: Column) -> Column:
    given = F.coalesce(b["attribute"], F.array())
    names = given["_name"]
    # Hardly any lacks its name, and lambda functions are not compiled.
    nameless = (F.size(names) > 0) & F.get(F.sort_array(names), F.lit(0)).isNull()
    named = F.when(
        nameless, F.transform(names, lambda n: F.coalesce(n, F.lit("")))
    ).otherwise(names)
    fixed = {
        "occluded": F.coalesce(b["_occluded"] == "1", F.lit(False)),
        "image_width": width,
        "image_height": height,
    }
    return attributes(fixed, F.arrays_zip(named.alias("name"), given["_VALUE"].alias("value")))


def _listed(images: DataFrame, boxes: bool, shapes: bool) -> DataFrame:
    """A row per box, polygon and polyline of an image, in this order, by numbers.

    The lists are not put together by lambda functions, which Spark does not compile. What the
    image says is read once for all its rows.
    """

    def count(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0))

    sized = settle(
        images,
        boxes=count("box"), polygons=count("polygon"), polylines=count("polyline"),
        **{f"read{n}": F.col(n).try_cast("double") for n in SIZES},
        **{f"text{n}": number(F.col(n)).cast("string") for n in SIZES},
    )
    begin = F.lit(0) if boxes else F.col("boxes")
    wanted = [F.col("boxes")] * boxes + [F.col("polygons") + F.col("polylines")] * shapes
    at = begin + F.col("n")
    shape = at - F.col("boxes")
    is_polygon = shape < F.col("polygons")
    return sized.select(
        "*", F.posexplode(F.array_repeat(F.lit(True), sum(wanted, F.lit(0)))).alias("n", "_there")
    ).select(
        "file", "_id", "_name", *SIZES, *[f"{kind}{n}" for kind in ("read", "text") for n in SIZES],
        (shape < 0).alias("is_box"),
        F.when(shape < 0, at).otherwise(shape).alias("place"),
        F.get("box", at).alias("b"),
        F.when(is_polygon, "polygon").otherwise("polyline").alias("tag"),
        F.when(is_polygon, F.get("polygon", shape)).otherwise(
            F.get("polyline", shape - F.col("polygons"))
        ).alias("s"),
    )


def _image_rows(images: DataFrame, boxes: bool = True, shapes: bool = True) -> DataFrame:
    """A row per entry; readable shapes under two points are dropped.

    Numbers are read once for a row, before it is looked whether they all could be read.
    """
    rows = settle(
        _listed(images, boxes, shapes),
        points=points_from_text("s._points"),
        **{f"read{n}": F.col(f"b.{n}").try_cast("double") for n in CORNERS},
    )
    b, points, is_box = F.col("b"), F.col("points"), F.col("is_box")
    read = {n[1:]: F.col(f"read{n}") for n in (*CORNERS, *SIZES)}
    size = {n[1:]: F.col(n) for n in SIZES}
    half = F.when(half_read(points), F.array(F.lit("points"))).otherwise(
        F.array().cast("array<string>")
    )
    unread = F.when(is_box, unreadable({**_named(b), **size}, read)).otherwise(
        F.concat(half, unreadable(size, read))
    )
    outlined = F.coalesce(F.size(points) >= 2, F.lit(False))
    corners = box(*[F.coalesce(f"read{n}", F.lit(0.0)) for n in CORNERS])
    return rows.filter(is_box | outlined | (F.size(unread) > 0)).select(
        *record(
            F.coalesce("_name", F.lit(UNKNOWN)),
            F.coalesce(F.when(is_box, b["_label"]).otherwise(F.col("s._label")), F.lit(UNKNOWN)),
            F.when(is_box, corners).otherwise(bounding_box(points)), TOOL,
            F.when(is_box, _box_attributes(b, *[F.col(f"text{n}") for n in SIZES])).otherwise(
                attributes({"type": F.col("tag")})
            ),
            order_key(
                F.col("file"), F.col("_id"), F.when(is_box, 0).otherwise(1), F.col("place")
            ),
        ),
        unread.alias("unreadable"),
    )


def image_rows(images: DataFrame) -> DataFrame:
    """Records of the boxes, polygons and polylines of parsed images, with ``unreadable``.

    ``images``: ``IMAGE_ELEMENT`` plus ``file``. An absent number is 0. One that is there but
    cannot be read, of a box or of its image, is named in ``unreadable``, as is ``points`` where
    a coordinate of a shape is no number; ``readable`` and ``rejected`` part the rows.
    """
    return _image_rows(images)


def image_boxes(images: DataFrame) -> DataFrame:
    """Records of the readable boxes in parsed image elements (``IMAGE_ELEMENT`` plus ``file``)."""
    return readable(_image_rows(images, shapes=False))


def image_shapes(images: DataFrame) -> DataFrame:
    """Records of readable polygons, then polylines, as bounding boxes; under two points dropped."""
    return readable(_image_rows(images, boxes=False))


def track_rows(tracks: DataFrame) -> DataFrame:
    """Records of all boxes of video tracks (``TRACK_ELEMENT`` plus ``file``), with ``unreadable``."""
    rows = tracks.select(
        "file", "_id", "_label", "_source", F.posexplode("box").alias("place", "b")
    ).withColumn("frame", F.coalesce("b._frame", F.lit("0")))
    attrs = attributes({"frame": F.col("frame"), "source": F.coalesce("_source", F.lit(""))})
    return rows.select(
        *record(
            F.concat(F.lit("frame_"), "frame"), F.coalesce("_label", F.lit(UNKNOWN)),
            _corner_box(F.col("b")), TOOL, attrs,
            order_key(F.col("file"), F.col("_id"), F.lit(2), F.col("place")),
        ),
        unreadable(_named(F.col("b"))).alias("unreadable"),
    )


def track_boxes(tracks: DataFrame) -> DataFrame:
    """Records of the readable boxes of video tracks (``TRACK_ELEMENT`` plus ``file``)."""
    return readable(track_rows(tracks))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def xml_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one export file, a folder of them or a glob, with ``unreadable``.

    A file is read by one task, element by element, once for images and once for tracks.
    """
    images = _elements(spark, path, "image", IMAGE_ELEMENT)
    tracks = _elements(spark, path, "track", TRACK_ELEMENT)
    return merge_annotations(spark, image_rows(images), track_rows(tracks))


def load_xml_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Records of export files; those with unreadable numbers are in ``load_xml_rejects``."""
    return readable(xml_rows(spark, path))


def load_xml_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What in export files could not be read, see ``rejected``."""
    return rejected(xml_rows(spark, path))
