from pyspark.sql import functions as F

from folioflow.functions.geometry import points_from_text
from folioflow.sources import box_text, task_json, xml_boxes

WIDE = "concat('<image id=\"', id, '\"><box label=\"a\" xtl=\"1\"/></image>')"


def lambdas_of(frame):
    """The lines of the plan with a lambda function in them."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "lambdafunction" in line]


def test_numbers_are_read_outside_lambda_functions(spark):
    """Spark compiles nothing within lambda functions; attributes not asked for are not made."""
    images = spark.range(1).select(
        F.lit("f").alias("file"), F.from_xml(F.expr(WIDE), xml_boxes.IMAGE_ELEMENT).alias("p")
    ).select("file", "p.*")
    tasks = spark.range(1).select(
        F.lit("f").alias("file"), F.from_json(F.lit('{"id": 1}'), task_json.TASK).alias("p")
    ).select("file", "p.*")
    lines = spark.range(1).select(
        F.lit("s").alias("stem"), F.concat(F.lit("1 .5 .5 .1 .1 "), "id").alias("value"))
    boxes = xml_boxes.image_boxes(images).select("label", "bbox")
    found = lambdas_of(boxes)
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert "image_width" not in plan and "map(" not in plan
    assert found and not any("AS DOUBLE" in line.upper() for line in found if "Generate" in line)
    records = task_json.task_records(tasks).select("label", "bbox")
    assert "rotation," not in records._jdf.queryExecution().optimizedPlan().toString()
    assert not lambdas_of(box_text.box_records(lines))


def test_pieces_of_points(evaluate_text):
    texts = ["1,2;3,4", "1,2,9;;7;x,5;,6", "", None, ";8,\n9", "5"]
    found = evaluate_text(points_from_text("text"), *texts)
    assert [v and [tuple(p) for p in v] for v in found] == [
        [(1.0, 2.0), (3.0, 4.0)], [(1.0, 2.0), (None, 5.0), (None, 6.0)], [], None,
        [(8.0, 9.0)], []]
