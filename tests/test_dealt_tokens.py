import math

import pytest
from pyspark.sql import functions as F

from catalogue import inputs
from folioflow.operators.tokens import read_pages
from folioflow.plans.extract import documents_from_tokens
from folioflow.schemas import TOKENS_TABLE

OUTLINES = [
    [(5, 1), (9, 1), (9, 4), (5, 4)], [(1, 1), (3, 3)], [(2, 1), None, (4, 4), (2, 4)],
    [(7, 2), (None, 2), (8, 8), (7, None)], None, [], [(3, 0), (4, 0), (5, 2), (4, 3), (3, 2)],
]


def outlined(spark):
    rows = [("d", p, "e", p * 10 + i, None if i == 1 else f"w{p}{i}", i / 4 or None, box)
            for p in range(3) for i, box in enumerate(OUTLINES)]
    return spark.createDataFrame(rows, TOKENS_TABLE)


@pytest.mark.parametrize("seq, axis", [("int", "int"), ("bigint", "double"), ("string", "int")])
def test_dealt_tokens_are_the_same(spark, seq, axis):
    """Whatever the outlines and types: as without dealing, and unpacked without lists."""
    points = f"array<struct<x: {axis}, y: {axis}>>"
    tokens = outlined(spark).withColumns(
        {"seq": F.col("seq").cast(seq), "bbox": F.col("bbox").cast(points)})
    dealt = read_pages(tokens, tasks=5)
    plain = read_pages(tokens)
    assert dealt.schema["tokens"].dataType.simpleString() == (
        plain.schema["tokens"].dataType.simpleString())
    found = {r.page: r for r in dealt.collect()}
    assert found == {r.page: r for r in plain.collect()} and len(found) == 3
    boxes = {t.text: t.bbox and [p and tuple(p) for p in t.bbox] for t in found[2].tokens}
    assert boxes == {None if i == 1 else f"w2{i}": box for i, box in enumerate(OUTLINES)}
    assert "transform(" not in dealt._jdf.queryExecution().executedPlan().toString()
    whole = documents_from_tokens(tokens.filter("page = 1"), tokens, tasks=3).first()
    expected = documents_from_tokens(tokens.filter("page = 1"), tokens).first()
    assert whole == expected and len(whole.tokens) == 3 * len(OUTLINES)


def test_engines_of_different_types(spark):
    primary = outlined(spark).filter("page = 0")
    secondary = outlined(spark).withColumns({
        "seq": F.col("seq").cast("bigint"), "extra": F.lit(1),
        "bbox": F.col("bbox").cast("array<struct<x: double, y: double>>")})
    dealt = documents_from_tokens(primary, secondary, tasks=3).first()
    assert dealt == documents_from_tokens(primary, secondary).first()


def test_text_that_a_task_takes_apart_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TOKENIZED_BYTES", 100_000)
    folder = "/root/testdata/sf0.01"
    size = inputs.table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    for tokens in inputs.two_engines(spark, folder, bounded=True):
        assert tokens.rdd.getNumPartitions() == math.ceil(size / 100_000) > 8
