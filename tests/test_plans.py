"""Shape of the physical plans."""

import pytest

from catalogue.queries import QUERIES
from folioflow.plans.extract import extract_documents, predict_first_pages

SMALL = "/root/testdata/sf0.001"
# Queries that run jobs while they are built; their results are checked in test_entry.
EAGER = (
    "stream_", "artifact_", "report_", "keyframes_of_events", "labels_from_csv", "xml_files",
    "xml_rejects", "task_json_files", "task_json_rejects", "box_text_files", "directory_files",
    "zip_files",
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: plan_of(query(spark, SMALL))
        for name, query in QUERIES.items()
        if not name.startswith(EAGER)
    }


def test_extraction_is_map_only(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = plan_of(extract_documents(documents))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_only_maps_and_archives_use_python(plans):
    markers = ("Python", "MapInArrow", "MapInPandas")
    assert {n for n, plan in plans.items() if any(m in plan for m in markers)} == {
        "zip_expand", "guarded_map", "engine_pages", "step_timings"}


def test_no_cross_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_page_filter_reaches_the_scan(plans):
    assert "LessThan(turn,5)" in plans["page_cap"]


def test_parsing_is_not_repeated_by_pushed_filters(plans):
    for name, parser in (("xml_image_boxes", "from_xml("), ("task_json_records", "from_json(")):
        assert plans[name].count(parser) == 1, name


def test_first_page_filter_precedes_extraction(spark):
    pages = spark.read.parquet(f"{SMALL}/conversations.parquet").selectExpr(
        "CAST(conv_id AS STRING) file_path", "turn page", "text", "1.0D preprocessing_ms",
        "1.0D overhead_reduction_pct")
    assert "LessThan(turn,1)" in plan_of(predict_first_pages(pages))
