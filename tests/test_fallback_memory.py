from pyspark.sql import functions as F

from folioflow.operators.tokens import engine_fallback


def test_tokens_of_the_second_engine_are_not_sorted(spark):
    """Only the keys of served pages are held; tokens pass by, and a hot page is still split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        tokens = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
            F.lit(0).alias("page"), F.lit("first").alias("engine"), F.col("id").alias("seq"))
        primary = tokens.filter("doc_id % 5 = 0")
        merged = engine_fallback(primary, tokens)
        found = {r.engine: r["count"] for r in merged.groupBy("engine").count().collect()}
        merged.collect()
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    served = sum(1 for i in range(60000) if i % 3 and i % 5 == 0)
    assert found == {"first": served, "tesseract_fallback": 60000 - served}
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "Sort")
    assert "skew=true" in plan
