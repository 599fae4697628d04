"""One query per operator; each reads whole driver tables and returns flat, named columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.amounts import amount_candidates, total_amount
from folioflow.functions.classify import classify
from folioflow.functions.dates import invoice_date
from folioflow.functions.geometry import box_height, box_width
from folioflow.functions.summary import summarize
from folioflow.functions.timing import overhead_reduction_pct, process_time_header
from folioflow.functions.vendor import vendor
from folioflow.operators import evaluate as ev
from folioflow.operators.columns import settle
from folioflow.operators.documents import (
    OCR_RESULT,
    document_id,
    first_with_tokens,
    map_documents,
    number_documents,
)
from folioflow.operators.reports import (
    batch_report,
    latency_metrics,
    success_split,
    timing_report,
)
from folioflow.operators.sampling import newest, sample_media, sample_ordered, sample_positions
from folioflow.operators.tokens import (
    assemble_documents,
    cap_pages,
    engine_fallback,
    polygon_tokens,
    read_pages,
    token_rows,
    usable_tokens,
)
from folioflow.operators.vendors import name_index, vendor_mentions
from folioflow.plans.batch import directory_items, directory_problems
from folioflow.plans.extract import (
    documents_from_tokens,
    extract_documents,
    flatten,
    predict_first_pages,
    with_vendor_table,
)
from folioflow.session import scratch_path
from folioflow.sources import box_text, sinks, task_json, xml_boxes
from folioflow.sources.annotations import merge_annotations, name_classes
from folioflow.sources.archives import expand_archive_files, expand_archives
from folioflow.sources.files import (
    check_archives,
    discover,
    media_kind,
    read_labels,
    route_media,
)
from folioflow.sources.listing import list_tree, with_content
from folioflow.sources.ranges import listed_files
from folioflow.streaming import artifacts
from folioflow.streaming.batches import report_stream
from folioflow.streaming.extract import (
    breach_alerts,
    extract_stream,
    extract_stream_with_names,
    request_log,
)
from folioflow.streaming.latency import current_metrics, keep_history
from folioflow.streaming.rings import keep_rings, newest_rings, ring_history, ring_metrics
from folioflow.streaming.windows import (
    keep_windows,
    latency_windows,
    merge_windows,
    window_metrics,
)

from . import inputs
from .inputs import spread_table, table


# Text ---------------------------------------------------------------------------------


def classify_keywords(spark, sf_dir):
    return inputs.bills(spark, sf_dir).select("doc_id", classify("text").alias("c")).select(
        "doc_id", "c.doc_type", "c.confidence"
    )


def classify_documents(spark, sf_dir):
    documents = spread_table(spark, sf_dir, "documents", "text")
    typed = documents.select(classify("text").alias("c")).select("c.*")
    return typed.groupBy("doc_type", "confidence").agg(F.count(F.lit(1)).alias("documents"))


def extract_dates(spark, sf_dir):
    return inputs.bills(spark, sf_dir).select("doc_id", invoice_date("text").alias("d")).select(
        "doc_id", F.col("d.value").alias("invoice_date"), F.col("d.confidence").alias("confidence")
    )


def extract_amounts(spark, sf_dir):
    return inputs.bills(spark, sf_dir).select("doc_id", total_amount("text").alias("a")).select(
        "doc_id", F.col("a.value").alias("amount"), "a.currency", "a.confidence"
    )


def amount_candidates_plain(spark, sf_dir):
    """Plain digits accepted and subtotals penalised: the options of the amount search."""
    found = amount_candidates("text", plain_digits=True, penalise_subtotal=True)
    rows = inputs.bills(spark, sf_dir).select("doc_id", F.inline(found))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("score") == 0.9).alias("near_total"),
        F.count_if(F.col("score") == 0.3).alias("near_subtotal"),
        F.max("value").alias("largest"),
    )


def extract_vendor_line(spark, sf_dir):
    return inputs.bills(spark, sf_dir).select("doc_id", vendor("text").alias("v")).select(
        "doc_id", F.col("v.value").alias("vendor"), "v.confidence"
    )


def vendor_dictionary(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return vendor_mentions(inputs.customer_bills(spark, sf_dir), names)


def summarize_documents(spark, sf_dir):
    documents = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return documents.select(
        "doc_id", F.array_join(summarize("text"), " | ").alias("summary")
    )


def _flat(extracted: DataFrame) -> DataFrame:
    flat = flatten(
        extracted, "doc_id", "classification_confidence", "summary",
    )
    return flat.withColumn("summary", F.array_join("summary", " | "))


def extract_bills(spark, sf_dir):
    return _flat(extract_documents(inputs.customer_bills(spark, sf_dir)))


def extract_corpus(spark, sf_dir):
    return _flat(extract_documents(spread_table(spark, sf_dir, "documents", "doc_id", "text")))


def extract_with_vendor_table(spark, sf_dir):
    bills = inputs.customer_bills(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    extracted = with_vendor_table(extract_documents(bills), bills, names)
    return _flat(extracted).select("doc_id", "vendor", "vendor_conf", "date", "amount")


# Evaluation ---------------------------------------------------------------------------


def _evaluation(spark, sf_dir) -> ev.Evaluation:
    labels = inputs.bill_labels(spark, sf_dir)
    pages = ev.labelled_pages(inputs.bill_pages(spark, sf_dir), labels)
    return ev.evaluate(labels, predict_first_pages(pages))


def evaluate_fields(spark, sf_dir):
    return ev.metrics_by_field(_evaluation(spark, sf_dir).summary)


def evaluate_summary(spark, sf_dir):
    return _evaluation(spark, sf_dir).summary.select(
        "total_documents", "failed", "doc_type_correct", "avg_preprocessing_ms",
        "overall_accuracy", "doc_type_accuracy", "target_met",
    )


def evaluate_details(spark, sf_dir):
    return _evaluation(spark, sf_dir).details.select(
        "file_path", "success", "vendor_match", "date_match", "amount_match", "doc_type_match",
        "pred_vendor", "pred_date", "pred_amount",
    )


def evaluate_skipped(spark, sf_dir):
    return _evaluation(spark, sf_dir).skipped.select("doc_id", "file_path")


def labels_from_csv(spark, sf_dir):
    """Labels stored as CSV with columns in another order and some dates and amounts unreadable."""
    key = F.col("o_orderkey")
    path = scratch_path(spark, "labels")
    table(spark, sf_dir, "orders").select(
        F.when(key % 6 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("invoice_date"),
        inputs.file_name(key).alias("file_path"),
        F.when(key % 15 == 0, "n/a").when(key % 4 != 0, key.cast("string")).alias("total_amount"),
        key.alias("doc_id"),
    ).write.csv(path, header=True)
    return read_labels(spark, path).select(
        "doc_id", "file_path", "vendor_name", "invoice_date", "total_amount",
        F.array_join("malformed", ",").alias("malformed"),
    )


# Tokens -------------------------------------------------------------------------------


def _page_columns(pages: DataFrame) -> DataFrame:
    return pages.select(
        "doc_id", "page", "engine", F.size("tokens").cast("bigint").alias("tokens"),
        F.md5(F.col("full_text")).alias("text_md5"),
    )


def reading_order(spark, sf_dir):
    tasks = inputs.token_tasks(spark, sf_dir)
    return _page_columns(read_pages(inputs.word_tokens(spark, sf_dir), tasks=tasks))


def engine_fallback_tokens(spark, sf_dir):
    primary, secondary = inputs.two_engines(spark, sf_dir)
    merged = engine_fallback(primary, secondary)
    return merged.groupBy("doc_id", "page", "engine").agg(F.count(F.lit(1)).alias("tokens"))


def _document_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", "engine", F.col("pages").cast("bigint").alias("pages"),
        F.size("tokens").cast("bigint").alias("tokens"), F.md5(F.col("text")).alias("text_md5"),
    )


def page_assembly(spark, sf_dir):
    # Pages and then documents are grouped from one partitioning by document.
    tasks = inputs.token_tasks(spark, sf_dir)
    tokens = inputs.word_tokens(spark, sf_dir).repartition(tasks, "doc_id")
    return _document_columns(assemble_documents(read_pages(tokens)))


def documents_with_fallback(spark, sf_dir):
    primary, secondary = inputs.two_engines(spark, sf_dir, bounded=True)
    pages = inputs.token_pages(spark, sf_dir)
    tasks = inputs.token_tasks(spark, sf_dir)
    return _document_columns(documents_from_tokens(primary, secondary, pages, tasks=tasks))


def page_cap(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    capped = cap_pages(turns, page="turn")
    return capped.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.char_length("text")).alias("chars")
    )


def token_filter_boxes(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("  "), F.when(F.col("l_returnflag") == "N", " ").otherwise(
            F.col("l_returnflag")), F.lit("\t")).alias("text"),
        (F.col("l_discount") * 20).alias("conf"),
        F.col("l_linenumber").alias("left"), F.col("l_quantity").cast("int").alias("top"),
        F.lit(30).alias("width"), F.lit(10).alias("height"),
    )
    corner = F.col("bbox")[2]
    return usable_tokens(raw).select(
        "l_orderkey", "l_linenumber", "text", F.round("confidence", 6).alias("confidence"),
        corner["x"].cast("bigint").alias("right"), corner["y"].cast("bigint").alias("bottom"),
    )


# Annotations --------------------------------------------------------------------------


def _record_columns(records: DataFrame, *attributes: str) -> DataFrame:
    return records.select(
        "image_path", "label", "source_tool",
        *[F.round(F.col(f"bbox.{c}"), 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")],
        *[F.try_element_at("attributes", F.lit(a)).alias(a) for a in attributes],
    )


def _parsed(rows: DataFrame, column: str, parse, schema: str) -> DataFrame:
    parsed = settle(rows, p=parse(column, schema))
    return parsed.select(F.lit("t").alias("file"), "p.*")


def xml_image_boxes(spark, sf_dir):
    images = _parsed(inputs.xml_images(spark, sf_dir), "xml", F.from_xml, xml_boxes.IMAGE_ELEMENT)
    return _record_columns(
        xml_boxes.image_boxes(images), "occluded", "image_width", "image_height", "status"
    )


def xml_image_shapes(spark, sf_dir):
    images = _parsed(inputs.xml_images(spark, sf_dir), "xml", F.from_xml, xml_boxes.IMAGE_ELEMENT)
    return _record_columns(xml_boxes.image_shapes(images), "type")


def xml_track_boxes(spark, sf_dir):
    tracks = _parsed(inputs.xml_tracks(spark, sf_dir), "xml", F.from_xml, xml_boxes.TRACK_ELEMENT)
    return _record_columns(xml_boxes.track_boxes(tracks), "frame", "source")


def task_json_records(spark, sf_dir):
    tasks = _parsed(inputs.json_tasks(spark, sf_dir), "json", F.from_json, task_json.TASK)
    return _record_columns(task_json.task_records(tasks), "rotation", "type")


def box_text_records(spark, sf_dir):
    lines = inputs.box_lines(spark, sf_dir)
    records = _record_columns(box_text.box_records(lines), "class_id", "normalised")
    return records.groupBy("image_path", "label", "source_tool", "class_id", "normalised").agg(
        F.count(F.lit(1)).alias("boxes"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
    )


def box_text_with_sizes(spark, sf_dir):
    records = box_text.box_records(
        inputs.box_lines(spark, sf_dir), images=inputs.image_sizes(spark, sf_dir)
    )
    sized = records.select(
        "image_path", box_width("bbox").alias("w"), box_height("bbox").alias("h"), "attributes"
    )
    return sized.groupBy("image_path").agg(
        F.count(F.lit(1)).alias("boxes"),
        F.round(F.max("w"), 6).alias("width"), F.round(F.max("h"), 6).alias("height"),
        F.max(F.try_element_at("attributes", F.lit("normalised"))).alias("normalised"),
    )


def class_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("class_id"))
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("label")
    )
    return name_classes(lines, names).groupBy("class_id", "label").agg(
        F.count(F.lit(1)).alias("boxes")
    )


def merged_annotations(spark, sf_dir):
    images = _parsed(inputs.xml_images(spark, sf_dir), "xml", F.from_xml, xml_boxes.IMAGE_ELEMENT)
    tasks = _parsed(inputs.json_tasks(spark, sf_dir), "json", F.from_json, task_json.TASK)
    merged = merge_annotations(
        spark, xml_boxes.image_boxes(images), task_json.task_records(tasks),
        box_text.box_records(inputs.box_lines(spark, sf_dir)),
    )
    return merged.groupBy("source_tool", "label").agg(
        F.count(F.lit(1)).alias("records"), F.count("bbox").alias("boxes")
    )


def _rejects(rows: DataFrame) -> DataFrame:
    return rows.select(
        "image_path", "label", "source_tool", F.array_join("unreadable", ",").alias("unreadable")
    )


def xml_files(spark, sf_dir):
    path = scratch_path(spark, "xml")
    inputs.write_xml_files(spark, sf_dir, path)
    return _record_columns(xml_boxes.load_xml_boxes(spark, path), "type", "source")


def xml_rejects(spark, sf_dir):
    path = scratch_path(spark, "xml")
    inputs.write_xml_files(spark, sf_dir, path)
    return _rejects(xml_boxes.load_xml_rejects(spark, path))


def task_json_files(spark, sf_dir):
    """Arrays of tasks read by small blocks, so that many tasks share a file."""
    path = scratch_path(spark, "tasks")
    inputs.write_task_arrays(spark, sf_dir, path)
    records = task_json.load_task_json(spark, path, block_bytes=1 << 18)
    return _record_columns(records, "rotation", "type")


def task_json_rejects(spark, sf_dir):
    path = scratch_path(spark, "tasks")
    inputs.write_task_arrays(spark, sf_dir, path)
    return _rejects(task_json.load_task_rejects(spark, path, block_bytes=1 << 18))


def box_text_files(spark, sf_dir):
    """Label files with hidden names too, and lines that cannot be read."""
    path = scratch_path(spark, "labels")
    inputs.write_label_files(spark, sf_dir, path)
    lines = box_text.read_lines(spark, path)
    boxes = box_text.box_records(lines).groupBy("image_path", "label").agg(
        F.count(F.lit(1)).alias("boxes"), F.round(F.max("bbox.x_max"), 6).alias("x_max")
    )
    unread = box_text.rejected_lines(lines).groupBy(F.col("stem").alias("image_path")).agg(
        F.lit("rejected").alias("label"), F.count(F.lit(1)).alias("boxes"),
        F.lit(None).cast("double").alias("x_max"),
    )
    return boxes.unionByName(unread)


# Reports and sampling -----------------------------------------------------------------


def latency_report(spark, sf_dir):
    return latency_metrics(inputs.requests(spark, sf_dir), ("ts", "event_id"))


def newest_per_path(spark, sf_dir):
    kept = newest(inputs.requests(spark, sf_dir), ("ts", "event_id"), 20, ("path",))
    return kept.select("path", "event_id", F.round("elapsed_ms", 4).alias("elapsed_ms"))


def sla_breaches(spark, sf_dir):
    alerts = breach_alerts(inputs.requests(spark, sf_dir), 1500.0)
    return alerts.select("event_id", "level", "message")


def request_lines(spark, sf_dir):
    log = request_log(inputs.requests(spark, sf_dir))
    return log.select("event_id", process_time_header("elapsed_ms").alias("header"), "level")


def batch_summary(spark, sf_dir):
    return batch_report(inputs.batch_results(spark, sf_dir))


def batch_summary_by_user(spark, sf_dir):
    report = batch_report(inputs.batch_results(spark, sf_dir), by=("user_id",))
    return report.drop("error", "total_elapsed_sec", "throughput_docs_per_sec")


def overhead_stats(spark, sf_dir):
    return timing_report(inputs.requests(spark, sf_dir))


def overhead_per_request(spark, sf_dir):
    pct = overhead_reduction_pct(F.col("elapsed_ms") * 100)
    return inputs.requests(spark, sf_dir).groupBy(pct.alias("saved_pct")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def keyframes_of_media(spark, sf_dir):
    media = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("media_id"),
        F.col("p_size").alias("total_frames"),
    )
    return sample_media(media)


def keyframes_of_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return sample_positions(turns, "conv_id", "turn", 3).select("conv_id", "turn", "sample_no")


def keyframes_of_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    sampled = sample_ordered(events, "event_type", ("ts", "event_id"), 50)
    return sampled.select("event_type", "position", "sample_no", "event_id")


# Files, harness, sinks ----------------------------------------------------------------


def _paths(spark, sf_dir) -> DataFrame:
    endings = [".jpg", ".PNG", ".mp4", ".pdf", "", ".tar.webp", ".zip"]
    key = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (key % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        key,
        F.concat(F.lit("/in/d"), (key % 10).cast("string"), F.lit("/p"), key.cast("string"),
                 ending).alias("path"),
        F.when(key % 3 == 0, "application/pdf").when(key % 3 == 1, "image/png").alias(
            "content_type"),
        F.when(key % 14 == 6, 0).otherwise(F.length("html")).cast("bigint").alias("length"),
    )


def scan_discovery(spark, sf_dir):
    return discover(_paths(spark, sf_dir)).select("page_id", "kind", "directory", "name")


def directory_files(spark, sf_dir):
    """Files written and read again: images with content, frames of videos, and problems."""
    path = scratch_path(spark, "pages")
    inputs.write_page_files(spark, sf_dir, path)
    files = list_tree(spark, path)
    key = F.regexp_extract("path", r"([0-9]+)\.mp4$", 1).try_cast("bigint")
    counts = files.filter((key % 2 == 0) & (key % 3 != 0)).select(
        "path", (key % 5 * 3).cast("int").alias("total_frames")
    )
    # Contents are read for the files that are images only.
    pictures = with_content(files.filter(media_kind("path") == "image"))
    movies = files.filter(media_kind("path") == "video").withColumn(
        "content", F.lit(None).cast("binary")
    )
    items = directory_items(pictures.unionByName(movies), counts).select(
        "source_path", F.coalesce("frame_idx", F.lit(-1)).alias("frame_idx"),
        F.md5("content").alias("content_md5"), F.lit(None).cast("string").alias("error"),
    )
    problems = directory_problems(files, counts).select(
        F.col("path").alias("source_path"), F.lit(-1).cast("bigint").alias("frame_idx"),
        F.lit(None).cast("string").alias("content_md5"), "error",
    )
    folder = path.rsplit("/", 1)[1]
    name = F.element_at(F.split("source_path", f"/{folder}/"), -1)
    return items.unionByName(problems).withColumn("source_path", name)


def zip_files(spark, sf_dir):
    """Members of ZIP files read one by one through ranges of the files."""
    path = scratch_path(spark, "zips")
    inputs.write_archives(spark, sf_dir, path)
    members = expand_archive_files(listed_files(spark, path, "*.zip"))
    return members.select(
        F.regexp_extract("archive", "([^/]*)$", 1).alias("archive"), "member_index", "member",
        F.md5("content").alias("content_md5"), F.col("error").isNotNull().alias("broken"),
    )


def media_routing(spark, sf_dir):
    return route_media(_paths(spark, sf_dir)).select("page_id", "kind")


def upload_guards(spark, sf_dir):
    accepted, rejected = check_archives(_paths(spark, sf_dir))
    return accepted.select("page_id", F.lit("accepted").alias("reason")).unionByName(
        rejected.select("page_id", "reason")
    )


def zip_expand(spark, sf_dir):
    members = expand_archives(inputs.archives(spark, sf_dir))
    return members.select(
        "archive", F.col("member_index").cast("bigint").alias("member_index"), "member",
        F.md5("content").alias("content_md5"), F.col("error").isNotNull().alias("broken"),
    )


def _count_letters(row, task):
    with task.step("count"):
        if row["n_chars"] % 10 == 0:
            raise ValueError("unreadable page")
        return {"letters": row["text"].count("e")}


def guarded_map(spark, sf_dir):
    documents = spread_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    done = map_documents(documents, _count_letters, "letters BIGINT", keep=("doc_id",))
    return done.select("doc_id", "success", "error", "letters")


def _load_engine():
    return {"confidence": 0.75}


def _first_engine(row, task):
    with task.step("first"):
        if row["rank"] is None:
            raise ValueError("unreadable page")
        if row["rank"] % 5 == 0:
            return []
        return _engine_tokens(row["text"].split(), task)


def _second_engine(row, task):
    with task.step("second"):
        return _engine_tokens(row["text"].lower().split(), task)


def _engine_tokens(words, task):
    confidence = task.model["confidence"]
    return [
        {"text": w, "confidence": confidence, "bbox": [{"x": 9 * i, "y": 0}] * 4}
        for i, w in enumerate(words)
    ]


def engine_pages(spark, sf_dir):
    """Parts as pages with ids beyond 2**53 and missing ranks, read by two engines."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        (key.cast("bigint") + F.lit(1 << 53)).alias("doc_id"),
        F.lit(0).alias("page"),
        F.when(key % 3 != 0, key).cast("bigint").alias("rank"),
        F.col("p_type").alias("text"),
    )
    read = first_with_tokens(_first_engine, _second_engine)
    results = map_documents(parts, read, OCR_RESULT, _load_engine, keep=("doc_id", "page"))
    good, _ = success_split(results)
    return _page_columns(read_pages(polygon_tokens(token_rows(good)))).drop("page")


def step_timings(spark, sf_dir):
    """How often each step of the two engines ran, and whether all took time."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        key.alias("doc_id"), F.lit(0).alias("page"),
        F.when(key % 3 != 0, key).cast("bigint").alias("rank"), F.col("p_type").alias("text"),
    )
    read = first_with_tokens(_first_engine, _second_engine)
    results = map_documents(parts, read, OCR_RESULT, _load_engine, keep=("doc_id",))
    return results.select(F.explode("timings").alias("step", "ms")).groupBy("step").agg(
        F.count(F.lit(1)).alias("runs"), (F.min("ms") >= 0).alias("measured")
    )


def document_names(spark, sf_dir):
    key = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(
        key, F.when(key % 3 != 0, F.col("url")).alias("source_path")
    )
    named = number_documents(pages, "page_id")
    return named.select("page_id", "source_path", document_id().alias("doc_id"))


def artifact_sink(spark, sf_dir):
    path = scratch_path(spark, "artifacts")
    sinks.write_artifacts(extract_documents(inputs.bills(spark, sf_dir)), None, path, buckets=4)
    stored = spark.read.parquet(f"{path}/extractions")
    return flatten(stored, "doc_id").select("doc_id", "doc_type", "vendor", "date", "amount")


def report_sink(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(timing_report(inputs.requests(spark, sf_dir)), path)
    return spark.read.json(path).drop("timestamp")


def evaluation_sink(spark, sf_dir):
    """The stored report of the evaluation, its details counted from their part files."""
    path = scratch_path(spark, "evaluation")
    sinks.write_evaluation(_evaluation(spark, sf_dir), path)
    summary, details, manifest = sinks.read_evaluation(spark, path)
    counted = F.struct(
        F.count(F.lit(1)).alias("rows"), F.count_if("vendor_match").alias("vendor_matches"),
        F.min("file_path").alias("first_file"), F.max("file_path").alias("last_file"),
    )
    found = details.agg(counted.alias("found")).scalar()
    metrics = F.col("metrics")
    return summary.select("*", found.alias("found")).select(
        "total_documents", metrics["overall_accuracy"].alias("overall_accuracy"),
        metrics["vendor"]["precision"].alias("vendor_precision"),
        metrics["amount"]["f1"].alias("amount_f1"), "target_met",
        F.col("preprocessing.avg_ms_per_doc").alias("avg_ms_per_doc"),
        "found.rows", manifest.agg(F.sum("rows").alias("listed")).scalar().alias("listed"),
        (F.col("details.rows") == F.col("found.rows")).alias("counted"),
        "found.vendor_matches", "found.first_file", "found.last_file",
    )


# Streams ------------------------------------------------------------------------------


def _stream(spark, sf_dir, name) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # A glob, since a file stream takes a folder or a glob but not the name of one file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}?parquet")


def stream_extract(spark, sf_dir):
    path = scratch_path(spark, "stream-extract")
    vendor_text = F.concat(F.lit("Trading House "), F.col("o_custkey").cast("string"))
    columns = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    orders = _stream(spark, sf_dir, "orders").select(*columns)
    # The table may be a single file, hence a single task: spread its narrow rows first.
    spread = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    bills = spread.select(
        F.col("o_orderkey").alias("doc_id"), inputs.bill_text(vendor_text).alias("text")
    )
    extract_stream(bills, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{path}/out")
    return flatten(stored, "doc_id").select("doc_id", "doc_type", "vendor", "date", "amount")


def stream_vendor_table(spark, sf_dir):
    """Bills as a stream, half of the customers being known vendors."""
    path = scratch_path(spark, "stream-vendors")
    house = F.concat(F.lit("Trading House "), F.col("c_custkey").cast("string"))
    known = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, house).alias("name")
    )
    names = name_index(known)
    columns = ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    orders = _stream(spark, sf_dir, "orders").select(*columns)
    spread = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    vendor_text = F.concat(F.lit("Trading House "), F.col("o_custkey").cast("string"))
    bills = spread.select(
        F.col("o_orderkey").alias("doc_id"), inputs.bill_text(vendor_text).alias("text")
    )
    extract_stream_with_names(bills, names, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{path}/out")
    return flatten(stored, "doc_id").select("doc_id", "vendor", "vendor_conf", "date", "amount")


def stream_metrics(spark, sf_dir):
    path = scratch_path(spark, "stream-metrics")
    requests = _stream(spark, sf_dir, "events").select(*inputs.request_columns())
    order = ("ts", "event_id")
    keep_history(requests, f"{path}/history", f"{path}/checkpoint", order).awaitTermination()
    return current_metrics(spark, f"{path}/history", requests.schema, order)


def _arriving(spark, sf_dir, path, start):
    """Run a stream over the requests three times, a third of the time and what is late added."""
    arriving = inputs.arrivals(spark, sf_dir)
    for part in range(3):
        arriving.filter(F.col("part") == part).drop("part").write.mode("append").parquet(
            f"{path}/in"
        )
        stream = spark.readStream.schema(arriving.drop("part").schema).parquet(f"{path}/in")
        start(stream).awaitTermination()


def _closed_windows(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "stream-windows")

    def start(stream):
        windows = latency_windows(stream, "6 hours", "1 hour")
        return keep_windows(windows, f"{path}/out", f"{path}/checkpoint")

    _arriving(spark, sf_dir, path, start)
    return spark.read.parquet(f"{path}/out")


def _window_columns(windows: DataFrame) -> DataFrame:
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm")
    return window_metrics(windows).withColumn("window_start", start).drop("window_end")


def stream_windows(spark, sf_dir):
    """Latency by path and 6 hours of event time; requests over an hour late are left out."""
    return _window_columns(_closed_windows(spark, sf_dir))


def stream_windows_by_day(spark, sf_dir):
    """The states of the 6-hour windows merged to days."""
    return _window_columns(merge_windows(_closed_windows(spark, sf_dir), "1 day"))


def latency_by_window(spark, sf_dir):
    """The same windows over a table, overlapping, without late requests."""
    requests = inputs.whole_requests(spark, sf_dir)
    return _window_columns(latency_windows(requests, "1 day", slide="12 hours"))


def _ring_stream(spark, sf_dir, size):
    path = scratch_path(spark, "stream-rings")
    order = ("ts", "event_id")
    rings = {}

    def start(stream):
        rings["of"] = newest_rings(stream, order, size=size)
        return keep_rings(rings["of"], f"{path}/rings", f"{path}/checkpoint")

    _arriving(spark, sf_dir, path, start)
    return f"{path}/rings", rings["of"], order


def stream_newest_per_path(spark, sf_dir):
    """The 100 newest requests of each path after a stream that ran three times."""
    root, rings, order = _ring_stream(spark, sf_dir, 100)
    kept = ring_history(spark, root, rings, order, size=100)
    return kept.select("path", "event_id", "elapsed_ms")


def stream_metrics_per_path(spark, sf_dir):
    root, rings, order = _ring_stream(spark, sf_dir, 1000)
    return ring_metrics(spark, root, rings, order)


def stream_artifacts(spark, sf_dir):
    """Artifacts of a stream in which every third document arrives again with two pages only."""
    path = scratch_path(spark, "stream-artifacts")
    key = F.col("conv_id")
    documents = inputs.conversation_documents(spark, sf_dir).select(
        key, key.cast("string").alias("doc_id"), "pages"
    )
    again = documents.filter(key % 3 == 0).withColumn("pages", F.slice("pages", 1, 2))
    for number, arriving in enumerate((documents, again, again)):
        arriving.select("doc_id", F.lit(number).cast("bigint").alias("arrived"), "pages").write.mode(
            "append"
        ).parquet(f"{path}/in")
        if number == 1:
            continue  # the second and third arrive in one batch
        stream = spark.readStream.schema(artifacts.DOCUMENTS).parquet(f"{path}/in")
        artifacts.keep_artifacts(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    pages = artifacts.stored_pages(spark, f"{path}/out").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.size("tokens")).alias("tokens")
    )
    stored = artifacts.stored_extractions(spark, f"{path}/out").select("doc_id", "doc_type")
    return stored.join(pages, "doc_id")


def stream_breaches(spark, sf_dir):
    path = scratch_path(spark, "stream-breaches")
    requests = _stream(spark, sf_dir, "events").select(*inputs.request_columns())
    (
        breach_alerts(requests, 1500.0)
        .writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{path}/out").select("event_id", "level", "message")


def _text_length(row, task):
    text = bytes(row["content"]).decode("utf-8")
    if len(text) % 7 == 0:
        raise ValueError("unreadable page")
    return {"chars": len(text)}


def stream_batches(spark, sf_dir):
    path = scratch_path(spark, "stream-batches")
    inputs.archives(spark, sf_dir).write.parquet(f"{path}/in")
    arriving = spark.readStream.schema("path STRING, length BIGINT, content BINARY").parquet(
        f"{path}/in"
    )
    report_stream(
        arriving, _text_length, "chars BIGINT", f"{path}/out", f"{path}/checkpoint"
    ).awaitTermination()
    reports = spark.read.parquet(f"{path}/out/reports")
    return reports.select(
        "archive", "total_documents", "successful", "failed",
        F.col("error").isNotNull().alias("broken"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    function.__name__: function
    for function in (
        classify_keywords, classify_documents, extract_dates, extract_amounts,
        amount_candidates_plain, extract_vendor_line, vendor_dictionary, summarize_documents,
        extract_bills, extract_corpus, extract_with_vendor_table,
        evaluate_fields, evaluate_summary, evaluate_details, evaluate_skipped, labels_from_csv,
        reading_order, engine_fallback_tokens, page_assembly, documents_with_fallback, page_cap,
        token_filter_boxes,
        xml_image_boxes, xml_image_shapes, xml_track_boxes, task_json_records, box_text_records,
        box_text_with_sizes, class_lookup, merged_annotations,
        xml_files, xml_rejects, task_json_files, task_json_rejects, box_text_files,
        latency_report, newest_per_path, sla_breaches, request_lines, batch_summary,
        batch_summary_by_user, overhead_stats, overhead_per_request,
        keyframes_of_media, keyframes_of_turns, keyframes_of_events,
        scan_discovery, media_routing, upload_guards, zip_expand, guarded_map,
        directory_files, zip_files, engine_pages, step_timings, document_names,
        artifact_sink, report_sink, evaluation_sink,
        stream_extract, stream_vendor_table, stream_metrics, stream_breaches, stream_batches,
        stream_windows, stream_windows_by_day, latency_by_window,
        stream_newest_per_path, stream_metrics_per_path, stream_artifacts,
    )
}
