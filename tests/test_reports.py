import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions.timing import (
    log_level, log_line, overhead_reduction_pct, process_time_header, ranked_percentile,
)
from folioflow.operators.reports import (
    NO_MEMBERS, batch_report, latency_metrics, mean_preprocessing_ms, success_split,
    timing_report,
)
from folioflow.operators.sampling import newest
from folioflow.streaming.extract import breach_alerts, request_log

START = datetime.datetime(2024, 1, 1)


def requests(spark, values):
    rows = [(START + datetime.timedelta(seconds=i), "GET", "/x", float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "ts TIMESTAMP, method STRING, path STRING, elapsed_ms DOUBLE")


def metrics(spark, values):
    return latency_metrics(requests(spark, values)).first().asDict()


def test_no_requests(spark):
    found = metrics(spark, [])
    assert found.pop("sla_threshold_ms") == 2000.0
    assert set(found.values()) == {0}


def test_small_histories(spark):
    assert metrics(spark, [5])["p50_ms"] == 5.0
    two = metrics(spark, [9, 5])
    assert (two["p50_ms"], two["avg_ms"], two["max_ms"]) == (9.0, 7.0, 9.0)
    assert metrics(spark, [10, 20, 30, 40, 50])["p50_ms"] == 30.0
    edge = metrics(spark, [2000.0, 2000.5])
    assert edge["sla_violation_pct"] == 50.0


def test_history_is_bounded(spark):
    found = metrics(spark, [9000] * 200 + list(range(1000)))
    assert found["total_requests"] == 1000 and found["max_ms"] == 999.0
    assert (found["p50_ms"], found["p95_ms"], found["p99_ms"]) == (500.0, 950.0, 990.0)


def test_percentile_rule_for_many_sizes(spark):
    def expected(n, percent):
        return float(max(0, min(n - 1, round(percent / 100 * n))))

    sizes = spark.range(1, 140).select(
        "id", F.transform(F.sequence(F.lit(0), F.col("id") - 1), lambda v: v.cast("double"))
        .alias("ms"))
    found = sizes.select("id", *[
        ranked_percentile(F.col("ms"), p).alias(f"p{p}") for p in (50, 95, 99)]).collect()
    for row in found:
        assert [row.p50, row.p95, row.p99] == [expected(row.id, p) for p in (50, 95, 99)]


def results(spark, rows):
    return spark.createDataFrame(
        rows, "doc STRING, success BOOLEAN, total_ms DOUBLE, started_at DOUBLE, finished_at DOUBLE")


def test_batch_report(spark):
    rows = [("a", True, 100.0, 0.0, 1.0), ("b", True, 2000.0, 1.0, 3.0),
            ("c", True, 2500.0, 2.0, 4.0), ("d", False, 5.0, 0.5, 0.6)]
    found = batch_report(results(spark, rows)).first()
    assert (found.total_documents, found.successful, found.failed) == (4, 3, 1)
    assert (found.total_elapsed_sec, found.throughput_docs_per_sec) == (4.0, 1.0)
    assert (found.avg_latency_ms, found.max_latency_ms) == (1533.33, 2500.0)
    assert found.sub_2s_transactions_pct == 25.0 and found.error is None
    assert batch_report(results(spark, rows), elapsed_sec=8).first().throughput_docs_per_sec == 0.5


def test_batch_report_without_success_or_documents(spark):
    failed = batch_report(results(spark, [("a", False, 5.0, 0.0, 0.0)])).first()
    assert (failed.avg_latency_ms, failed.max_latency_ms, failed.failed) == (0.0, 0.0, 1)
    assert failed.throughput_docs_per_sec == 0.0
    empty = batch_report(results(spark, []), empty_message=NO_MEMBERS).first()
    assert empty.total_documents == 0 and empty.error == NO_MEMBERS
    assert empty.sub_2s_transactions_pct == 0.0 and empty.throughput_docs_per_sec == 0.0


def test_success_split(spark):
    rows = [("a", True, 1.0, 0.0, 0.0), ("b", False, 1.0, 0.0, 0.0), ("c", None, 1.0, 0.0, 0.0)]
    good, bad = success_split(results(spark, rows))
    assert [r.doc for r in good.collect()] == ["a"]
    assert sorted(r.doc for r in bad.collect()) == ["b", "c"]


def test_overhead(spark):
    frame = spark.createDataFrame([(24.1,), (30000.0,), (45000.0,)], "elapsed_ms DOUBLE")
    assert [r[0] for r in frame.select(overhead_reduction_pct("elapsed_ms")).collect()] == [
        99.9, 0.0, 0.0]
    report = timing_report(spark.createDataFrame([(24.1,)] * 20, "elapsed_ms DOUBLE")).first()
    assert (report.num_documents, report.total_ms, report.avg_ms_per_doc) == (20, 482.0, 24.1)
    assert (report.manual_total_s, report.overhead_reduction_pct) == (600.0, 99.9)
    nothing = timing_report(frame.limit(0)).first()
    assert nothing.num_documents == 0 and nothing.overhead_reduction_pct == 0.0
    mean = mean_preprocessing_ms(frame.withColumnRenamed("elapsed_ms", "preprocessing_ms"))
    assert mean.first()[0] == pytest.approx(25008.03)


def test_log_lines(spark):
    frame = requests(spark, [2000.0, 2000.06])
    rows = frame.select(
        process_time_header("elapsed_ms"), log_level("elapsed_ms"),
        log_line("method", "path", "elapsed_ms")).collect()
    assert [tuple(r) for r in rows] == [
        ("2000.00", "INFO", "GET /x — 2000.0 ms"),
        ("2000.06", "WARNING", "SLA BREACH — GET /x took 2000.1 ms (threshold: 2000.0 ms)")]
    assert breach_alerts(frame).count() == 1 and request_log(frame).count() == 2


def test_newest_per_group(spark):
    frame = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    kept = newest(frame, ["id"], 2, ["g"])
    assert sorted(r.id for r in kept.collect()) == [94, 95, 96, 97, 98, 99]
