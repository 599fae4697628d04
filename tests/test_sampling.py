import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.sampling import (
    numbered_in_order, sample_media, sample_ordered, sample_positions,
)


def media(spark, total, **options):
    frame = spark.createDataFrame([("v", total)], "media_id STRING, total_frames INT")
    rows = sample_media(frame, **options).orderBy("sample_no").collect()
    return [r.frame_idx for r in rows], [r.source_path for r in rows]


def test_media_frames(spark):
    assert media(spark, 0)[0] == []
    assert media(spark, -3)[0] == []
    assert media(spark, None)[0] == []
    assert media(spark, 7)[0] == list(range(7))
    assert media(spark, 25)[0] == list(range(0, 20, 2))
    assert media(spark, 12, frame_interval=5)[0] == [0, 5, 10]
    assert media(spark, 2_000_000_000, frame_interval=1, max_frames=2)[0] == [0, 1]
    assert media(spark, 25, max_frames=5)[1][1] == "v::frame_1"


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
@pytest.mark.parametrize("frame_interval", [None, 7])
def test_sample_with_a_dominant_group(spark, broadcast_rows, frame_interval):
    rng = random.Random(5)
    keys = ["hot" if rng.random() < 0.5 else rng.choice([None, *"abcdefgh"]) for _ in range(5000)]
    rows = [(key, i, i) for i, key in enumerate(keys)]
    frame = spark.createDataFrame(rows, "k STRING, t BIGINT, _no BIGINT").repartition(7)
    groups = {}
    for key, t, _ in rows:
        groups.setdefault(key, []).append(t)
    expected = set()
    for key, times in groups.items():
        step = frame_interval or max(1, len(times) // 10)
        expected |= {(key, times[p], p, p // step) for p in range(0, len(times), step)[:10]}
    sampled = sample_ordered(frame, "k", ["t"], 10, frame_interval, broadcast_rows).collect()
    assert {(r.k, r.t, r.position, r.sample_no) for r in sampled} == expected
    assert len(sampled) == len(expected)
    assert sample_ordered(frame.limit(0), "k", ["t"]).count() == 0


def test_runs_of_a_group_add_up(spark):
    frame = spark.range(5000).select((F.col("id") % 2).alias("g"), "id").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored, runs = numbered_in_order(frame, "g", ["id"])
        found = stored.join(runs, ["g", "_part"]).selectExpr("g", "id", "_start + _number AS p", "_total")
        rows = found.collect()
        assert len(rows) == 5000 and runs.groupBy("g").count().filter("count > 1").count() == 2
        assert all(r.p == r.id // 2 and r._total == 2500 for r in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_sort_spreads_the_dominant_group(spark):
    frame = spark.range(20000).select(F.lit("hot").alias("k"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = frame.orderBy("k", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) > 1


def test_positions(spark):
    frame = spark.range(12).select(F.lit(1).alias("g"), F.col("id").alias("turn"))
    rows = sample_positions(frame, "g", "turn", frame_interval=5).collect()
    assert sorted((r.turn, r.sample_no) for r in rows) == [(0, 0), (5, 1), (10, 2)]
