import random

from folioflow.operators.tokens import (
    assemble_documents, cap_pages, engine_fallback, polygon_tokens, read_pages,
    read_pages_with_fallback, usable_tokens,
)
from folioflow.plans.extract import documents_from_tokens
from folioflow.schemas import TOKENS_TABLE


def token(doc, page, seq, text, x, y, engine="easyocr"):
    corner = {"x": x, "y": y}
    return (doc, page, engine, seq, text, 0.9, [corner] * 4)


def tokens(spark, rows):
    return spark.createDataFrame(rows, TOKENS_TABLE)


def test_usable_tokens(spark):
    rows = [(" a ", 96.0), ("b", -1.0), ("c", 0.0), ("d", 0.7), ("e", 1.0), ("  ", 90.0),
            ("f", float("nan")), ("\xa0g", 50.5)]
    raw = spark.createDataFrame(
        [(t, c, 10, 20, 30, 40) for t, c in rows],
        "text STRING, conf DOUBLE, left INT, top INT, width INT, height INT",
    )
    kept = {r.text: r for r in usable_tokens(raw).collect()}
    assert {t: r.confidence for t, r in kept.items()} == {"a": 0.96, "e": 0.01, "g": 0.505}
    assert [tuple(p) for p in kept["a"].bbox] == [(10, 20), (40, 20), (40, 60), (10, 60)]


def test_polygon_is_truncated(spark):
    raw = spark.createDataFrame([([(1.9, -1.9)],)], "bbox ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    assert [tuple(p) for p in polygon_tokens(raw).first().bbox] == [(1, -1)]


def test_reading_order_is_stable(spark):
    rows = [token("d", 0, 0, "late", 0, 50), token("d", 0, 1, "right", 90, 10),
            token("d", 0, 2, "left", 10, 10), token("d", 0, 3, "tie2", 10, 20),
            token("d", 0, 4, "tie1", 10, 20)]
    random.Random(3).shuffle(rows)
    page = read_pages(tokens(spark, rows).repartition(3)).first()
    assert page.full_text == "left right tie2 tie1 late"
    assert [t.text for t in page.tokens] == page.full_text.split(" ")


def fallback_case(spark):
    primary = tokens(spark, [token("d", 0, 0, "p0", 0, 0), token("e", 0, 0, "q", 0, 0)])
    secondary = tokens(spark, [
        token("d", 0, 0, "unused", 0, 0, "tesseract"), token("d", 1, 1, "b", 5, 5, "tesseract"),
        token("d", 1, 0, "a", 9, 1, "tesseract"), token("z", 0, 0, "unlisted", 0, 0, "tesseract")])
    pages = spark.createDataFrame(
        [("d", 0), ("d", 1), ("d", 2), ("e", 0)], "doc_id STRING, page INT")
    return primary, secondary, pages


def test_fallback_tokens(spark):
    primary, secondary, _ = fallback_case(spark)
    merged = engine_fallback(primary, secondary).select("doc_id", "page", "engine", "text")
    assert sorted(map(tuple, merged.collect())) == [
        ("d", 0, "easyocr", "p0"), ("d", 1, "tesseract_fallback", "a"),
        ("d", 1, "tesseract_fallback", "b"), ("e", 0, "easyocr", "q"),
        ("z", 0, "tesseract_fallback", "unlisted")]


def test_fallback_pages_and_documents(spark):
    primary, secondary, pages = fallback_case(spark)
    read = read_pages_with_fallback(pages, primary, secondary)
    found = sorted((r.doc_id, r.page, r.engine, r.full_text) for r in read.collect())
    assert found == [("d", 0, "easyocr", "p0"), ("d", 1, "tesseract_fallback", "a b"),
                     ("d", 2, "tesseract_fallback", ""), ("e", 0, "easyocr", "q")]
    documents = {r.doc_id: r for r in documents_from_tokens(primary, secondary, pages).collect()}
    assert documents["d"].text == "p0\na b\n"
    assert (documents["d"].pages, documents["d"].engine) == (3, "easyocr")
    assert [t.text for t in documents["d"].tokens] == ["p0", "a", "b"]


def test_documents_without_page_list(spark):
    primary, secondary, _ = fallback_case(spark)
    both = {r.doc_id: r.text for r in documents_from_tokens(primary, secondary).collect()}
    assert both == {"d": "p0\na b", "e": "q", "z": "unlisted"}
    alone = {r.doc_id: r.text for r in documents_from_tokens(primary).collect()}
    assert alone == {"d": "p0", "e": "q"}


def test_page_cap(spark):
    rows = [token("d", page, 0, f"w{page}", 0, 0) for page in range(7)]
    (document,) = documents_from_tokens(tokens(spark, rows), max_pages=5).collect()
    assert document.text == "w0\nw1\nw2\nw3\nw4" and document.pages == 5
    assert cap_pages(tokens(spark, rows), 1).count() == 1


def test_assembly_without_tokens(spark):
    pages = spark.createDataFrame(
        [("d", 1, "e1", "two"), ("d", 0, "e0", "one"), ("d", 10, "e2", "three")],
        "doc_id STRING, page INT, engine STRING, full_text STRING")
    document = assemble_documents(pages).first()
    assert (document.text, document.engine, document.tokens) == ("one\ntwo\nthree", "e0", None)


def test_one_shuffle_from_tokens_to_documents(spark):
    primary, secondary, pages = fallback_case(spark)
    plan = documents_from_tokens(primary, secondary, pages)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1
    assert documents_from_tokens(primary)._jdf.queryExecution().executedPlan().toString().count(
        "Exchange hashpartitioning") == 1
