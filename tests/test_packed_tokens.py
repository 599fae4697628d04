from folioflow.operators.tokens import _packed, read_pages
from folioflow.schemas import TOKENS_TABLE


def test_outlines_of_any_shape_come_back(spark):
    """Four corners travel by axis; other outlines and missing corners are kept as well."""
    outlines = [
        [(5, 1), (9, 1), (9, 4), (5, 4)], [(1, 1), (3, 3)], [(2, 1), None, (4, 4), (2, 4)],
        [(7, 2), (None, 2), (8, 8), (7, None)], None, [(3, 0), (4, 0), (5, 2), (4, 3), (3, 2)],
    ]
    rows = [("d", 0, "e", i, f"w{i}", 0.5, box) for i, box in enumerate(outlines)]
    tokens = spark.createDataFrame(rows, TOKENS_TABLE)
    page = read_pages(tokens).first()
    assert page.full_text == "w4 w5 w1 w2 w0 w3"
    found = {t.text: t.bbox and [p and tuple(p) for p in t.bbox] for t in page.tokens}
    assert found == {f"w{i}": box for i, box in enumerate(outlines)}
    four = tokens.filter("seq = 0").select(_packed().alias("p")).select("p.*").first()
    assert (four.xs, four.ys, four.outline) == ([5, 9, 9, 5], [1, 1, 4, 4], None)


def test_tokens_are_dealt_over_the_given_tasks(spark):
    """No sort of the tokens before the shuffle, and as many parts after it as asked for."""
    tokens = spark.createDataFrame(
        [("d", i % 7, "e", i, f"w{i}", 0.5, [(i, 0)] * 4) for i in range(50)], TOKENS_TABLE)
    dealt = read_pages(tokens, tasks=13)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert dealt.rdd.getNumPartitions() == 13
    plain = {r.page: r for r in read_pages(tokens).collect()}
    assert {r.page: r for r in dealt.collect()} == plain and len(plain) == 7
