from pyspark.sql import functions as F

from folioflow.functions.geometry import half_read, points_from_text
from folioflow.sources.xml_boxes import image_boxes, image_rows, image_shapes, load_xml_boxes
from folioflow.sources.xml_boxes import IMAGE_ELEMENT

XML = """<image id="3" name="i" width="90" height="ninety">
<polyline label="p" points="1,2;3,4"/><box/><polygon label="q" points="1,2;x,4"/>
<box label="b" xtl="1" occluded="1"><attribute>nameless</attribute><attribute name="k">v</attribute></box>
<polygon label="dot" points="5,5"/></image>"""


def parsed(spark):
    texts = spark.createDataFrame([(XML,), ('<image id="4" name="none"/>',)], "xml STRING")
    images = texts.select(F.lit("f").alias("file"), F.from_xml("xml", IMAGE_ELEMENT).alias("p"))
    return images.select("file", "p.*")


def test_lists_are_not_built_by_lambda_functions(spark, tmp_path):
    """A row per entry comes from compiled expressions, numbers are read once."""
    (tmp_path / "e.xml").write_text(f"<annotations>{XML}</annotations>")
    records = load_xml_boxes(spark, str(tmp_path / "e.xml"))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert len(generated) == 4 and not any("lambdafunction" in line for line in generated)
    filters = [line for line in plan.splitlines() if "Filter" in line and "is_box" in line]
    assert filters and not any("try_cast" in line for line in filters)


def test_places_and_lists_of_entries(spark):
    rows = image_rows(parsed(spark)).collect()
    found = {
        (r.order_key.section, r.order_key.place): (r.label, r.attributes.get("type"), r.unreadable)
        for r in rows
    }
    assert len(rows) == 5 and {r.order_key.item for r in rows} == {3}
    assert found == {
        (0, 0): ("unknown", None, ["height"]), (0, 1): ("b", None, ["height"]),
        (1, 0): ("q", "polygon", ["points", "height"]), (1, 1): ("dot", "polygon", ["height"]),
        (1, 2): ("p", "polyline", ["height"])}
    named = next(r.attributes for r in rows if r.label == "b")
    assert named == {"occluded": "true", "image_width": "90.0", "image_height": "0.0",
                     "": "nameless", "k": "v"}


def test_boxes_and_shapes_alone(spark):
    images = parsed(spark).withColumn("_height", F.lit("90"))
    boxes = image_boxes(images).select("label", "order_key.section", "order_key.place")
    assert sorted(map(tuple, boxes.collect())) == [("b", 0, 1), ("unknown", 0, 0)]
    shapes = image_shapes(images).select("label", "order_key.section", "order_key.place")
    assert [tuple(r) for r in shapes.collect()] == [("p", 1, 2)]


def test_half_read_points(evaluate_text):
    texts = ["1,2;3,4", "1,2;x,4", "1,2;3,", "", None, "x,y"]
    found = evaluate_text(half_read(points_from_text("text")), *texts)
    assert [bool(v) for v in found] == [False, True, True, False, False, True]
