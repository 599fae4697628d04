import re

from pyspark.sql import functions as F

from folioflow.operators import vendors
from folioflow.operators.joins import key_bits, possible_keys
from folioflow.operators.vendors import vendor_mentions


def test_no_key_is_lost_and_few_others_stay(spark):
    keys = spark.range(0, 60000, 3, 4).select((F.col("id") - 20000).alias("a"), F.lit("k").alias("b"))
    rows = spark.range(0, 60000, 1, 4).select(
        (F.col("id") - 20000).alias("x"), F.when(F.col("id") >= 0, "k").alias("y"), "id")
    bits = key_bits(keys, "a", "b")
    kept = possible_keys(rows, bits, "x", "y")
    assert kept.columns == rows.columns
    found = {r.id for r in kept.collect()}
    assert found >= set(range(0, 60000, 3)) and len(found) < 20100
    assert possible_keys(rows, key_bits(keys.limit(0), "a", "b"), "x", "y").count() == 0
    lengths = bits.select(F.size("_bits").alias("n")).distinct().collect()
    assert [r.n for r in lengths] == [64]


def test_words_of_texts_are_not_shuffled(spark, monkeypatch):
    """Names too many to broadcast: only runs that may be a name leave their task."""
    monkeypatch.setattr(vendors, "small_side", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.range(3000).select(F.concat(F.lit("House "), "id", F.lit(" Ltd")).alias("name"))
        more = names.unionByName(spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name")))
        filler = "Some other words that open no name at all and House rules. "
        documents = spark.range(2000).select("id", F.concat(
            F.lit(filler), F.when(F.col("id") % 4 == 0, F.lit("at house ")).otherwise(F.lit("at ")),
            (F.col("id") * 2).cast("string"), F.lit(" LTD., n"), "id").alias("text"))
        found = vendor_mentions(documents, more, doc_id="id")
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r.id: r.vendor for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = {i: f"n{i}" for i in range(2000)}
    expected |= {i: f"House {2 * i} Ltd" for i in range(0, 1500, 4)}
    assert rows == expected
    joined = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[(\w+)#", plan)
    assert joined == ["_met"]
