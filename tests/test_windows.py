import datetime
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.sampling import newest
from folioflow.streaming import windows as w
from folioflow.streaming.rings import keep_rings, newest_rings, ring_history, ring_metrics
from folioflow.streaming.upserts import current_rows, superseded, upsert

REQUESTS = "ts TIMESTAMP, seq BIGINT, path STRING, elapsed_ms DOUBLE"
START = datetime.datetime(2024, 1, 1)


def requests(spark, rows):
    made = [(None if s is None else START + datetime.timedelta(seconds=s), i, p, ms) for i, (s, p, ms) in enumerate(rows)]
    return spark.createDataFrame(made, REQUESTS)


def index_rule(values, percent):
    ordered = sorted(values)
    if not ordered:
        return 0.0
    return ordered[max(0, min(len(ordered) - 1, round(percent / 100 * len(ordered))))]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 50, 150, 999, 1000])
def test_small_windows_follow_the_index_rule(spark, count):
    chance = random.Random(count)
    values = [float(chance.randint(0, 5000)) for _ in range(count)]
    frame = requests(spark, [(chance.randint(0, 3599), "/a", v) for v in values]).repartition(3)
    (row,) = w.window_metrics(w.latency_windows(frame)).collect()
    assert (row.p50_ms, row.p95_ms, row.p99_ms) == tuple(index_rule(values, p) for p in (50, 95, 99))
    assert row.total_requests == count and row.max_ms == max(values)
    assert row.sla_violation_pct == round(sum(v > 2000 for v in values) / count * 100, 2)


def test_large_windows_stay_within_the_rank_error(spark):
    frame = spark.range(200_000, numPartitions=8).select(
        F.lit(START).alias("ts"), F.lit("/a").alias("path"),
        (F.col("id") * 7919 % 200_000).cast("double").alias("elapsed_ms"))
    states = w.latency_windows(frame)
    (row,) = w.window_metrics(states).collect()
    for percent, found in ((50, row.p50_ms), (95, row.p95_ms), (99, row.p99_ms)):
        assert abs(found / 200_000 - percent / 100) < 0.004
    assert states.first().sketch is not None and len(states.first().sketch) < 200_000


def test_windows_merge_to_wider_ones(spark):
    chance = random.Random(3)
    rows = [(chance.randint(0, 4 * 3600 - 1), chance.choice(["/a", None]), float(i)) for i in range(400)]
    frame = requests(spark, rows)
    wide = w.window_metrics(w.latency_windows(frame, "4 hours"))
    merged = w.window_metrics(w.merge_windows(w.latency_windows(frame, "1 hour"), "4 hours"))
    assert sorted(map(str, wide.collect())) == sorted(map(str, merged.collect()))
    assert wide.count() == 2


def test_odd_requests(spark):
    frame = requests(spark, [(None, "/a", 1.0), (5, "/a", None), (6, "/b", 3.0), (7, "/b", None)])
    rows = {r.path: r for r in w.window_metrics(w.latency_windows(frame)).collect()}
    assert (rows["/a"].total_requests, rows["/a"].p99_ms, rows["/a"].avg_ms, rows["/a"].max_ms) == (1, 0, 0, 0)
    assert (rows["/b"].total_requests, rows["/b"].p50_ms, rows["/b"].avg_ms) == (2, 3.0, 3.0)
    assert w.window_metrics(w.latency_windows(frame.limit(0))).count() == 0
    overlapping = w.latency_windows(frame.filter("seq = 2"), "1 hour", slide="30 minutes")
    assert overlapping.count() == 2


def run_windows(spark, folder, schema, out, mark):
    stream = spark.readStream.schema(schema).parquet(folder)
    windows = w.latency_windows(stream, "1 hour", "10 minutes")
    w.keep_windows(windows, out, mark).awaitTermination()


def test_late_requests_are_left_out_and_restarts_change_nothing(spark, tmp_path):
    chance = random.Random(9)
    batches = []
    for hour in range(4):
        rows = [(hour * 3600 + chance.randint(0, 3599), "/a", float(chance.randint(1, 99))) for _ in range(50)]
        batches.append(rows)
    batches[2].append((60, "/a", 7.0))  # an hour and more late
    batches[1].append((3300, "/a", 8.0))  # late, but its window is open
    found = []
    for restart in (False, True):
        folder, out, mark = (str(tmp_path / f"{n}{restart}") for n in ("in", "out", "mark"))
        for rows in batches:
            frame = requests(spark, rows)
            frame.coalesce(1).write.mode("append").parquet(folder)
            run_windows(spark, folder, frame.schema, out, mark)
            if restart:  # nothing new arrives
                run_windows(spark, folder, frame.schema, out, mark)
        rows = w.window_metrics(spark.read.parquet(out)).orderBy("window_start").collect()
        found.append([tuple(r) for r in rows])
    assert found[0] == found[1] and len(found[0]) == 3
    assert [r[3] for r in found[0]] == [51, 50, 50]


def test_rings_equal_the_newest_of_all_batches(spark, tmp_path):
    chance = random.Random(4)
    rows = [(chance.randint(0, 900), chance.choice(["/hot"] * 8 + ["/b", "/c", None]), float(i % 50)) for i in range(600)]
    rows.append((None, "/b", 1.0))
    frame = requests(spark, rows)
    folder, root, mark = (str(tmp_path / n) for n in ("in", "rings", "mark"))
    order = ("ts", "seq")
    for part in range(3):
        frame.filter(F.col("seq") % 3 == part).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        rings = newest_rings(stream, order, size=20)
        keep_rings(rings, root, mark).awaitTermination()
    kept = ring_history(spark, root, rings, order, size=20)
    expected = newest(frame.filter("ts IS NOT NULL"), order, 20, ("path",))
    columns = ("path", "ts", "seq", "elapsed_ms")
    assert sorted(map(str, kept.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    metrics = {r.path: r for r in ring_metrics(spark, root, rings, order, size=20).collect()}
    hot = [r.elapsed_ms for r in expected.filter("path = '/hot'").collect()]
    assert metrics["/hot"].total_requests == 20 and metrics["/hot"].p95_ms == index_rule(hot, 95)


def test_idle_rings_are_dropped(spark, tmp_path):
    folder, root, mark = (str(tmp_path / n) for n in ("in", "rings", "mark"))
    for rows in ([(0, "/old", 1.0), (5, "/new", 2.0)], [(90_000, "/new", 3.0)], [(90_001, "/new", 4.0)]):
        frame = requests(spark, rows)
        frame.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        rings = newest_rings(stream, ("ts", "seq"), size=5, idle="1 hour", salts=1)
        keep_rings(rings, root, mark).awaitTermination()
    kept = ring_history(spark, root, rings, ("ts", "seq"), size=5).collect()
    assert {(r.path, r.elapsed_ms) for r in kept} == {("/new", v) for v in (2.0, 3.0, 4.0)} or {
        (r.path, r.elapsed_ms) for r in kept} == {("/new", v) for v in (3.0, 4.0)}


def test_upserts_replace_keys_and_may_run_again(spark, tmp_path):
    root, schema = str(tmp_path / "table"), "k STRING, page INT, v STRING"
    first = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), (None, 0, "n")], schema)
    second = spark.createDataFrame([("a", 0, "new"), ("c", 0, "c"), (None, 1, "m")], schema)
    assert current_rows(spark, root, first.schema).count() == 0
    upsert(first, 0, root, ["k"], buckets=2)
    for _ in range(2):
        upsert(second, 1, root, ["k"], buckets=2)
        rows = {tuple(r) for r in current_rows(spark, root, first.schema).collect()}
        assert rows == {("a", 0, "new"), ("b", 0, "z"), ("c", 0, "c"), (None, 1, "m")}
    before = {tuple(r) for r in current_rows(spark, root, first.schema, before=1).collect()}
    assert before == {tuple(r) for r in first.collect()}
    assert {r.batch for r in superseded(spark, root, first.schema).collect()} == {0}
    with pytest.raises(ValueError):
        upsert(second.withColumn("batch", F.lit(1)), 2, root, ["k"])
