"""Annotation exports as JSON tasks: rectangles, polygons and image-level labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.geometry import bounding_box, box, half_read, percent_to_pixel, point
from folioflow.operators.columns import settle

from .annotations import (
    UNKNOWN,
    attributes,
    number,
    order_key,
    readable,
    record,
    rejected,
    unreadable,
)
from .json_array import BLOCK_BYTES, array_elements

TOOL = "label_studio"
# Numbers are read as texts, which tell an absent one from an unreadable one.
RESULT = (
    "STRUCT<type: STRING, original_width: STRING, original_height: STRING, "
    "value: STRUCT<rectanglelabels: ARRAY<STRING>, polygonlabels: ARRAY<STRING>, "
    "points: ARRAY<ARRAY<STRING>>, taxonomy: ARRAY<ARRAY<STRING>>, "
    "x: STRING, y: STRING, width: STRING, height: STRING, rotation: STRING>>"
)
TASK = (
    "id BIGINT, data STRUCT<image: STRING, ocr: STRING, file_upload: STRING>, "
    f"annotations ARRAY<STRUCT<result: ARRAY<{RESULT}>>>"
)


def task_rows(tasks: DataFrame) -> DataFrame:
    """Records of parsed tasks (``TASK`` plus ``file``) with ``unreadable``.

    Other result types are ignored. An absent or null number is its default. One that is there
    but cannot be read, and ``points`` with a coordinate that is missing or no number, are
    named in ``unreadable``; ``readable`` and ``rejected`` part the rows. Numbers in quotes are
    read as numbers.
    """
    data = F.col("data")
    path = F.coalesce(
        F.nullif(data["image"], F.lit("")), F.nullif(data["ocr"], F.lit("")),
        data["file_upload"], F.lit(UNKNOWN),
    )
    results = tasks.select(
        "file", "id", path.alias("path"), F.posexplode("annotations").alias("a_no", "a")
    ).select("file", "id", "path", "a_no", F.posexplode("a.result").alias("place", "r"))

    r, value = F.col("r"), F.col("r.value")
    width, height = number(r["original_width"], 1.0), number(r["original_height"], 1.0)
    sizes = {n: r[n] for n in ("original_width", "original_height")}
    edges = {n: value[n] for n in ("x", "y", "width", "height")}
    all_read = F.array().cast("array<string>")

    def first_label(labels):
        return F.coalesce(F.get(labels, F.lit(0)), F.lit(UNKNOWN))

    def size(name, whole):
        return percent_to_pixel(number(value[name]), whole)

    x, y = size("x", width), size("y", height)
    rectangle = box(x, y, x + size("width", width), y + size("height", height))
    outline = F.transform(
        F.coalesce(value["points"], F.array()),
        lambda p: point(
            percent_to_pixel(F.get(p, F.lit(0)).try_cast("double"), width),
            percent_to_pixel(F.get(p, F.lit(1)).try_cast("double"), height),
        ),
    )

    def entry(names=F.lit(None), points=F.lit(None)):
        return F.struct(
            names.cast("ARRAY<STRING>").alias("names"),
            points.cast("ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>").alias("points"),
        )

    kind = r["type"]
    is_rectangle, is_polygon = kind == "rectanglelabels", kind == "polygonlabels"
    entries = (
        F.when(is_rectangle, F.array(entry()))
        .when(is_polygon, F.array(entry(points=outline)))
        .when(
            kind == "taxonomy",
            F.transform(
                F.coalesce(value["taxonomy"], F.array(F.expr("CAST(array() AS ARRAY<STRING>)"))),
                lambda names: entry(names),
            ),
        )
    )
    # Numbers are read from the rows of the entries: within an array's elements Spark works out
    # columns that are not asked for, and within a lambda function it compiles nothing.
    rows = results.select(
        "file", "id", "path", "a_no", "place", "r", F.posexplode(entries).alias("e_no", "e")
    )
    points = F.col("e.points")
    half = F.when(half_read(points), F.array(F.lit("points"))).otherwise(all_read)
    # Under two points there is no box, whether they can be read or not.
    return rows.filter(~is_polygon | (F.size(points) >= 2)).select(
        *record(
            F.col("path"),
            F.when(is_rectangle, first_label(value["rectanglelabels"]))
            .when(is_polygon, first_label(value["polygonlabels"]))
            .otherwise(F.coalesce(F.try_element_at("e.names", F.lit(-1)), F.lit(UNKNOWN))),
            F.when(is_rectangle, rectangle).when(is_polygon, bounding_box(points)),
            TOOL,
            F.when(
                is_rectangle, attributes({"rotation": F.coalesce(value["rotation"], F.lit("0"))})
            )
            .when(is_polygon, attributes({"type": F.lit("polygon")}))
            .otherwise(attributes({})),
            order_key(
                F.col("file"), F.col("id"), F.col("a_no"), F.col("place"), F.col("e_no")
            ),
        ),
        F.when(is_rectangle, unreadable({**edges, **sizes}))
        .when(is_polygon, F.concat(half, unreadable(sizes)))
        .otherwise(all_read).alias("unreadable"),
    )


def task_records(tasks: DataFrame) -> DataFrame:
    """Readable records of parsed tasks (``TASK`` plus ``file``)."""
    return readable(task_rows(tasks))


def read_tasks(
    spark: SparkSession, path: str, multi_line: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Tasks of JSON exports as ``TASK`` plus ``file``: an array of tasks or one task a file.

    Files of any size are read by blocks of ``block_bytes``, in many tasks. Files of another
    shape give no rows; an element that is no task has nulls only. With ``multi_line=False``
    the files hold a task per line.
    """
    if not multi_line:
        return spark.read.schema(TASK).json(path).withColumn("file", F.col("_metadata.file_path"))
    elements = array_elements(spark, path, block_bytes)
    parsed = settle(elements.select("file", "element"), p=F.from_json("element", TASK))
    return parsed.select("file", "p.*")


def load_task_json(
    spark: SparkSession, path: str, multi_line: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Records of JSON exports; those with unreadable numbers are in ``load_task_rejects``."""
    return task_records(read_tasks(spark, path, multi_line, block_bytes))


def load_task_rejects(
    spark: SparkSession, path: str, multi_line: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """What in JSON exports could not be read, see ``rejected``."""
    return rejected(task_rows(read_tasks(spark, path, multi_line, block_bytes)))
