import json

import pytest
from pyspark.errors import AnalysisException

from folioflow.functions.geometry import box_height, box_width
from folioflow.schemas import ANNOTATION
from folioflow.sources.annotations import merge_annotations
from folioflow.sources.box_text import load_box_text, read_lines, rejected_lines
from folioflow.sources.task_json import load_task_json, load_task_rejects
from folioflow.sources.xml_boxes import load_xml_boxes, load_xml_rejects

XML = """<?xml version="1.0" encoding="utf-8"?>
<annotations>
  <image id="0" name="scan-a7.png" width="910" height="705">
    <box label="letter" xtl="12" ytl="33" xbr="871" ybr="690" occluded="0"/>
    <box label="sender" xtl="48" ytl="51" xbr="405" ybr="96" occluded="1">
      <attribute name="lang">en</attribute><attribute name="lang">de</attribute>
      <attribute name="occluded">child</attribute><attribute name="empty"></attribute>
    </box>
    <polyline label="rule" points="6,8;17,11;junk"/>
    <polygon label="seal" points="215,330;298,336;251,402"/>
    <polygon label="dot" points="5,5"/>
    <polygon label="none" points=""/>
  </image>
  <image id="1" width="222" height="333"><box ytl="1" xbr="2" ybr="3"/></image>
  <track id="4" label="cart" source="manual">
    <box frame="7" outside="1" xtl="1" ytl="2" xbr="3" ybr="4"/><box xtl="9"/>
  </track>
</annotations>"""


def by_label(records):
    return {r.label: r for r in records.collect()}


def test_xml_boxes(spark, tmp_path):
    path = tmp_path / "export.xml"
    path.write_text(XML, encoding="utf-8")
    records = load_xml_boxes(spark, str(path))
    rows = records.orderBy("order_key.section", "order_key.item", "order_key.place").collect()
    assert [r.label for r in rows] == [
        "letter", "sender", "unknown", "seal", "rule", "cart", "cart"]
    assert {r.source_tool for r in rows} == {"cvat"}
    letter, sender, unnamed, seal, rule, frame7, frame0 = rows
    assert tuple(letter.bbox) == (12.0, 33.0, 871.0, 690.0)
    assert letter.attributes == {
        "occluded": "false", "image_width": "910.0", "image_height": "705.0"}
    assert sender.attributes == {
        "lang": "de", "occluded": "child", "empty": None,
        "image_width": "910.0", "image_height": "705.0"}
    assert unnamed.image_path == "unknown" and tuple(unnamed.bbox) == (0.0, 1.0, 2.0, 3.0)
    assert tuple(seal.bbox) == (215.0, 330.0, 298.0, 402.0)
    assert seal.attributes == {"type": "polygon"} and rule.attributes == {"type": "polyline"}
    assert tuple(rule.bbox) == (6.0, 8.0, 17.0, 11.0)
    assert (frame7.image_path, frame0.image_path) == ("frame_7", "frame_0")
    assert frame7.attributes == {"frame": "7", "source": "manual"}
    sizes = records.select("label", box_width("bbox").alias("w"), box_height("bbox").alias("h"))
    assert ("letter", 859.0, 657.0) in {tuple(r) for r in sizes.collect()}


def write_tasks(tmp_path, tasks):
    path = tmp_path / "tasks.json"
    path.write_text(json.dumps(tasks), encoding="utf-8")
    return str(path)


def task(results, **data):
    return {"id": 1, "data": data, "annotations": [{"result": results}]}


def test_task_rectangles(spark, tmp_path):
    rectangle = {"type": "rectanglelabels", "original_width": 500, "original_height": 300,
                 "value": {"x": 12, "y": 21, "width": 40, "height": 51,
                           "rectanglelabels": ["letter"], "rotation": 7.5}}
    bare = {"type": "rectanglelabels", "value": {"rectanglelabels": []}}
    path = write_tasks(tmp_path, [task([rectangle, bare, {"type": "choices", "value": {}}],
                                       image="a.jpg")])
    rows = by_label(load_task_json(spark, path))
    assert set(rows) == {"letter", "unknown"}
    assert tuple(rows["letter"].bbox) == pytest.approx((60.0, 63.0, 260.0, 216.0))
    assert rows["letter"].attributes == {"rotation": "7.5"}
    assert rows["unknown"].attributes == {"rotation": "0"}
    assert tuple(rows["unknown"].bbox) == (0.0, 0.0, 0.0, 0.0)
    assert rows["letter"].image_path == "a.jpg"


def test_task_polygons_and_taxonomy(spark, tmp_path):
    polygon = {"type": "polygonlabels", "original_width": 200, "original_height": 100,
               "value": {"polygonlabels": ["stamp"], "points": [[1, 2], [50, 40], [10, 90]]}}
    short = {"type": "polygonlabels", "value": {"points": [[1, 2]]}}
    paths = {"type": "taxonomy", "value": {"taxonomy": [["a", "b"], ["c"], []]}}
    absent, none = {"type": "taxonomy", "value": {}}, {"type": "taxonomy", "value": {"taxonomy": []}}
    path = write_tasks(tmp_path, task([polygon, short, paths, absent, none], image="", ocr="o.png"))
    rows = load_task_json(spark, path).orderBy("order_key").collect()
    assert [r.label for r in rows] == ["stamp", "b", "c", "unknown", "unknown"]
    assert tuple(rows[0].bbox) == (2.0, 2.0, 100.0, 90.0)
    assert rows[0].attributes == {"type": "polygon"}
    assert all(r.bbox is None and r.attributes == {} for r in rows[1:])
    assert {r.image_path for r in rows} == {"o.png"}


def test_task_paths_and_shapes(spark, tmp_path):
    result = [{"type": "taxonomy", "value": {}}]
    tasks = [task(result, file_upload="f.png"), task(result), {"id": 3, "data": {"image": "x"}}]
    rows = load_task_json(spark, write_tasks(tmp_path, tasks)).collect()
    assert sorted(r.image_path for r in rows) == ["f.png", "unknown"]
    assert load_task_json(spark, write_tasks(tmp_path, {"other": 1})).count() == 0


def test_task_lines(spark, tmp_path):
    result = [{"type": "taxonomy", "value": {"taxonomy": [["q"]]}}]
    path = tmp_path / "tasks.jsonl"
    path.write_text("\n".join(json.dumps(task(result, image=f"{i}")) for i in range(5)))
    assert load_task_json(spark, str(path), multi_line=False).count() == 5


@pytest.fixture
def label_dir(tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "img001.txt").write_text("0 0.4 0.6 0.6 0.5\n\n1 2 3\n")
    (folder / "img 0+é.txt").write_text("1\t0.2 0.7  0.1 0.4 0.77\n9 0.4 0.4 0.2 0.2\nx 1 1 1 1\n")
    (folder / "note.md").write_text("0 0.4 0.6 0.6 0.5\n")
    return str(folder)


def test_box_text(spark, label_dir):
    rows = {(r.image_path, r.label): r for r in load_box_text(spark, label_dir).collect()}
    assert set(rows) == {("img001", "invoice"), ("img 0+é", "receipt"), ("img 0+é", "class_9")}
    first = rows["img001", "invoice"]
    assert tuple(first.bbox) == pytest.approx((0.1, 0.35, 0.7, 0.85))
    assert first.attributes == {"class_id": "0", "normalised": "true"}
    assert first.source_tool == "roboflow"
    bad = rejected_lines(read_lines(spark, label_dir)).collect()
    assert [(r.stem, r.value) for r in bad] == [("img 0+é", "x 1 1 1 1")]


def test_box_text_class_names(spark, label_dir):
    named = load_box_text(spark, label_dir, {0: "zero"})
    assert {r.label for r in named.collect()} == {"zero", "class_1", "class_9"}
    table = spark.createDataFrame([(9, "nine"), (0, "null")], "class_id INT, label STRING")
    assert {r.label for r in load_box_text(spark, label_dir, table).collect()} == {
        "null", "class_1", "nine"}
    assert {r.label for r in load_box_text(spark, label_dir, {}).collect()} == {
        "class_0", "class_1", "class_9"}


def test_box_text_image_sizes(spark, label_dir):
    images = spark.createDataFrame(
        [("img001", ".png", "/i/img001.png", 640, 480), ("img001", ".tiff", "/i/t", 1, 1),
         ("img 0+é", ".webp", "/i/w", 5, 5), ("other", ".jpg", "/i/o", 7, 7)],
        "stem STRING, ext STRING, path STRING, width INT, height INT")
    rows = {r.image_path: r for r in load_box_text(spark, label_dir, images=images).collect()}
    assert set(rows) == {"/i/img001.png", "img 0+é"}
    assert tuple(rows["/i/img001.png"].bbox) == pytest.approx((64.0, 168.0, 448.0, 408.0))
    assert all(r.attributes["normalised"] == "false" for r in rows.values())


def test_unreadable_first_image_keeps_its_path(spark, label_dir):
    images = spark.createDataFrame(
        [("img001", ".jpg", "/i/broken.jpg", None, None), ("img001", ".png", "/i/p", 9, 9)],
        "stem STRING, ext STRING, path STRING, width INT, height INT")
    rows = {r.image_path: r for r in load_box_text(spark, label_dir, images=images).collect()}
    assert tuple(rows["/i/broken.jpg"].bbox) == pytest.approx((0.1, 0.35, 0.7, 0.85))


def test_missing_inputs_fail(spark, tmp_path):
    gone = str(tmp_path / "gone")
    for load in (load_xml_boxes, load_task_json, load_box_text):
        with pytest.raises(AnalysisException):
            load(spark, gone).collect()


def test_merge(spark, label_dir):
    one = load_box_text(spark, label_dir)
    assert merge_annotations(spark, one, one).count() == 2 * one.count()
    empty = merge_annotations(spark)
    assert empty.count() == 0 and empty.columns == one.columns
    assert spark.createDataFrame([], ANNOTATION).schema == empty.schema


def test_unreadable_numbers_are_rejected(spark, tmp_path):
    xml = """<annotations><image id="1" name="i" width="9" height="9">
      <box label="a" xtl="1" ytl="x" xbr="3" ybr=""/><box label="b" xbr="3"/>
      <polygon label="c" points="1,1;x,3"/><polygon label="d" points="1,1;3,3"/>
      <polyline label="e" points="1,1;2,"/></image>
      <image id="2" name="j" width="w"><box label="f"/><polygon label="g" points="5,5"/></image>
      <track id="3" label="h"><box frame="1" xtl="q"/><box frame="2" xtl="1"/></track></annotations>"""
    (tmp_path / "e.xml").write_text(xml)
    path = str(tmp_path / "e.xml")
    assert set(by_label(load_xml_boxes(spark, path))) == {"b", "d", "h"}
    rejects = {(r.image_path, r.label): r.unreadable for r in load_xml_rejects(spark, path).collect()}
    assert rejects == {
        ("i", "a"): ["ytl", "ybr"], ("i", "c"): ["points"], ("i", "e"): ["points"],
        ("j", "f"): ["width"], ("j", "g"): ["width"], ("frame_1", "h"): ["xtl"],
    }
    tasks = [{"id": 1, "data": {"image": "i"}, "annotations": [{"result": [
        {"type": "rectanglelabels", "value": {"x": 1, "width": "bad", "rectanglelabels": ["a"]}},
        {"type": "rectanglelabels", "value": {"x": 1.5, "width": None, "rectanglelabels": ["b"]}},
        {"type": "rectanglelabels", "original_width": [], "value": {"rectanglelabels": ["c"]}},
        {"type": "polygonlabels", "value": {"points": [[1, 2], [3]], "polygonlabels": ["d"]}},
        {"type": "polygonlabels", "value": {"points": [["x", 2]], "polygonlabels": ["e"]}},
        {"type": "polygonlabels", "value": {"points": [[1, 2], [3, 4]], "polygonlabels": ["f"]}},
    ]}]}]
    path = write_tasks(tmp_path, tasks)
    assert set(by_label(load_task_json(spark, path))) == {"b", "f"}
    rejects = {r.label: r.unreadable for r in load_task_rejects(spark, path).collect()}
    assert rejects == {"a": ["width"], "c": ["original_width"], "d": ["points"]}


def test_task_arrays_by_blocks_equal_tasks_by_line(spark, tmp_path):
    tasks = [{"id": i, "data": {"image": f"i{i}"}, "annotations": [{"result": [
        {"type": "rectanglelabels", "original_width": 10, "original_height": 20,
         "value": {"x": i % 90, "y": 5, "width": 5, "height": 5, "rectanglelabels": [f"\"{i}]"]}}]}]}
        for i in range(300)]
    whole = write_tasks(tmp_path, tasks)
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "t.json").write_text("\n".join(json.dumps(t) for t in tasks))
    columns = ("image_path", "label", "bbox", "attributes")
    by_blocks = load_task_json(spark, whole, block_bytes=1000).select(*columns).collect()
    by_lines = load_task_json(spark, str(lines), multi_line=False).select(*columns).collect()
    assert len(by_lines) == 300 and sorted(map(str, by_blocks)) == sorted(map(str, by_lines))
