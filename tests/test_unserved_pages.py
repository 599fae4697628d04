from pyspark.sql import functions as F

from folioflow.operators import tokens as operators
from folioflow.plans.extract import documents_from_tokens
from folioflow.schemas import TOKENS_TABLE


def engines(spark):
    """Thirty documents of ten pages, every fifth page without primary tokens."""
    rows = [(f"d{d}", p, "e", s, f"w{d}-{p}-{s}", 0.5, [(9 - s, p)] * 4)
            for d in range(30) for p in range(10) for s in range(4)]
    tokens = spark.createDataFrame(rows, TOKENS_TABLE)
    number = F.substring("doc_id", 2, 9).cast("int") + F.col("page")
    primary = tokens.filter(number % 5 != 0)
    secondary = tokens.filter(number % 15 != 0).withColumn("text", F.upper("text"))
    return primary, secondary, tokens.select("doc_id", "page").distinct()


def test_tokens_of_served_pages_stay_in_place(spark):
    primary, secondary, pages = engines(spark)
    dealt = documents_from_tokens(primary, secondary, pages, tasks=7)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    # Every way of a secondary token to the dealing shuffle leads over the bits.
    lines = plan[plan.index("REPARTITION_BY_NUM"):].splitlines()
    parts = [i for i, line in enumerate(lines) if "2 AS _rank" in line]
    assert parts and all("LeftSemi, BuildRight" in "\n".join(lines[i:i + 4]) for i in parts)
    expected = {r.doc_id: r for r in documents_from_tokens(primary, secondary, pages).collect()}
    assert {r.doc_id: r for r in dealt.collect()} == expected and len(expected) == 30
    without = {r.doc_id: r.text for r in documents_from_tokens(primary, secondary).collect()}
    found = documents_from_tokens(primary, secondary, tasks=7).collect()
    assert {r.doc_id: r.text for r in found} == without


def test_keys_of_other_types_are_the_same_pages(spark):
    primary, secondary, pages = engines(spark)
    number = F.substring("doc_id", 2, 9).cast("int")
    primary = primary.withColumn("doc_id", number)
    secondary = secondary.withColumn("doc_id", F.when(number > 0, number).cast("bigint"))
    pages = pages.select(
        F.when(number > 0, number).cast("smallint").alias("doc_id"),
        F.col("page").cast("bigint").alias("page"))
    kept = operators._unserved(pages, primary, secondary, ("doc_id", "page"))
    found = {(r.doc_id, r.page, r.text) for r in kept.collect()}
    wanted = {(d or None, p, f"W{d}-{p}-{s}") for d in range(30) for p in range(10)
              for s in range(4) if d == 0 and p % 15 or (d + p) % 5 == 0 and (d + p) % 15}
    assert found == wanted
    dealt = documents_from_tokens(primary, secondary, pages, tasks=3)
    plain = {r.doc_id: r.text for r in documents_from_tokens(primary, secondary, pages).collect()}
    assert {r.doc_id: r.text for r in dealt.collect()} == plain and None in plain
