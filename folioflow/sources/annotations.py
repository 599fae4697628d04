"""What all annotation loaders share: record shape, merging, class names, image sizes."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.strings import bind
from folioflow.operators.joins import first_per_key, lookup_join, small_side
from folioflow.schemas import ANNOTATION, BOX, ORDER_KEY

# Class names of the box-text format, image extensions in probing order.
CLASS_NAMES = {
    0: "invoice", 1: "receipt", 2: "field_vendor", 3: "field_date", 4: "field_amount",
}
PROBED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff")
UNKNOWN = "unknown"


def attributes(fixed: Mapping[str, Column], children: Column | None = None) -> Column:
    """String map of fixed entries, then ``children``, an ``array<struct<name, value>>``.

    A later entry of a name replaces earlier ones, fixed entries included.
    """
    if not fixed and children is None:
        return F.expr("CAST(map() AS MAP<STRING, STRING>)")
    pieces = [p for name, value in fixed.items() for p in (F.lit(name), value.cast("string"))]
    base = F.create_map(*pieces)
    if children is None:
        return base
    names = F.concat(F.array(*[F.lit(name) for name in fixed]), children["name"])
    texts = F.concat(F.array(*[v.cast("string") for v in fixed.values()]), children["value"])
    entries = F.arrays_zip(names.alias("name"), texts.alias("value"))
    once = F.size(F.array_distinct(names)) == F.size(names)
    # A name hardly ever comes twice, and looking for its last entry costs more than the rest.
    return (
        F.when(F.size(children) == 0, base)
        .when(once, F.map_from_arrays(names, texts))
        .otherwise(bind(entries, _last_of_each_name))
    )


def _last_of_each_name(pairs: Column) -> Column:
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))

    def last_value(name: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["name"] == name), -1)["value"]

    return bind(names, lambda keys: F.map_from_arrays(keys, F.transform(keys, last_value)))


def number(text: Column, default: float = 0.0) -> Column:
    """The number a text says, the default where there is none."""
    return F.coalesce(text.try_cast("double"), F.lit(default))


def unreadable(
    texts: Mapping[str, Column], numbers: Mapping[str, Column] | None = None
) -> Column:
    """Names of the texts that are there but say no number; ``numbers``: what they say, if known."""
    said = numbers or {n: t.try_cast("double") for n, t in texts.items()}
    bad = {n: t.isNotNull() & said[n].isNull() for n, t in texts.items()}
    names = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]))
    # The list is for few rows, and costs more than all the rest.
    return F.when(functools.reduce(operator.or_, bad.values()), names).otherwise(
        F.array().cast("array<string>")
    )


def readable(rows: DataFrame) -> DataFrame:
    """Records of rows whose numbers could all be read."""
    return rows.filter(F.size("unreadable") == 0).drop("unreadable")


def rejected(rows: DataFrame) -> DataFrame:
    """``image_path, label, source_tool, unreadable, order_key`` of the other rows.

    ``unreadable`` names what could not be read. Such rows give no record, rather than one
    with a made-up box.
    """
    return rows.filter(F.size("unreadable") > 0).drop("bbox", "attributes")


def record(
    image_path: Column, label: Column, bbox: Column, tool: str, attrs: Column, order_key: Column
) -> list[Column]:
    """The columns of a normalised annotation record."""
    return [
        image_path.alias("image_path"),
        label.alias("label"),
        bbox.cast(BOX).alias("bbox"),
        F.lit(tool).alias("source_tool"),
        attrs.alias("attributes"),
        order_key.cast(ORDER_KEY).alias("order_key"),
    ]


def order_key(
    file: Column, item: Column, section: Column, place: Column, part: Column | None = None
) -> Column:
    return F.struct(
        file.alias("file"),
        item.cast("bigint").alias("item"),
        section.cast("int").alias("section"),
        place.cast("int").alias("place"),
        (F.lit(0) if part is None else part).alias("part"),
    )


def merge_annotations(spark: SparkSession, *records: DataFrame) -> DataFrame:
    """All records of all inputs, duplicates kept; no input gives an empty table."""
    if not records:
        return spark.createDataFrame([], ANNOTATION)
    return functools.reduce(DataFrame.unionByName, records)


def name_classes(
    boxes: DataFrame, classes: Mapping[int, str] | DataFrame | None = None
) -> DataFrame:
    """Add ``label`` for ``class_id``; a class without a name becomes ``class_<id>``."""
    default = F.concat(F.lit("class_"), F.col("class_id").cast("string"))
    if isinstance(classes, DataFrame):
        names = first_per_key(
            classes.select(F.col("class_id").cast("int").alias("class_id"), "label"),
            ["class_id"], ["label"],
        )
        names = names.withColumnRenamed("label", "_label")
        small = small_side(names)
        if small is names:
            named = lookup_join(boxes, names, ["class_id"])
        else:
            named = boxes.join(small, "class_id", "left")
        return named.withColumn("label", F.coalesce("_label", default)).drop("_label")
    literal = CLASS_NAMES if classes is None else classes
    if not literal:
        return boxes.withColumn("label", default)
    names = F.create_map(*[F.lit(part) for pair in literal.items() for part in pair])
    return boxes.withColumn(
        "label", F.coalesce(F.try_element_at(names, F.col("class_id")), default)
    )


def attach_image_size(boxes: DataFrame, images: DataFrame | None) -> DataFrame:
    """Add ``image_path, image_width, image_height`` for each ``stem``.

    ``images``: ``stem, ext, path, width, height``. Among several files of one stem the first
    extension in probing order counts, readable or not; without one the stem is the path and
    the size 1 x 1.
    """
    if images is None:
        return boxes.select(
            "*", F.col("stem").alias("image_path"),
            F.lit(1.0).alias("image_width"), F.lit(1.0).alias("image_height"),
        )
    rank = F.array_position(F.array(*[F.lit(e) for e in PROBED_EXTENSIONS]), F.col("ext"))
    probed = images.select(
        "stem", rank.alias("_rank"), F.col("path").alias("_path"),
        F.col("width").cast("double").alias("_width"),
        F.col("height").cast("double").alias("_height"),
    ).filter("_rank > 0")
    chosen = first_per_key(probed, ["stem"], ["_rank", "_path"])
    sized = F.col("_width").isNotNull() & F.col("_height").isNotNull()
    return (
        lookup_join(boxes, chosen, ["stem"])
        .withColumn("image_path", F.coalesce("_path", "stem"))
        .withColumn("image_width", F.when(sized, F.col("_width")).otherwise(1.0))
        .withColumn("image_height", F.when(sized, F.col("_height")).otherwise(1.0))
        .drop("_rank", "_path", "_width", "_height")
    )
