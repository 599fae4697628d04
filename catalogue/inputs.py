"""Operator inputs derived from the driver tables, row by row and at any scale."""

from __future__ import annotations

import io
import math
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.columns import settle
from folioflow.sources.files import spread_scan, spread_tasks
from folioflow.sources.ranges import store_file, store_files

WORDS_PER_PAGE = 200
# Items of an export file, whatever the table's size.
ITEMS_PER_FILE = 2000
# Text that a task takes apart into tokens.
TOKENIZED_BYTES = 12 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, over all task slots even where its files cannot be split."""
    return spread_scan(table(spark, sf_dir, name).select(*columns))


def orders_of_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(
        spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )


def bill_text(vendor: Column) -> Column:
    """A bill for each order: head, body by kind, date line and total line by key modulus."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")

    def by(modulus: int, *choices: Column | str) -> Column:
        remainder = key % modulus
        chain = F.when(remainder == 0, choices[0])
        for index, choice in enumerate(choices[1:], start=1):
            chain = chain.when(remainder == index, choice)
        return chain

    def money(value: Column) -> Column:
        return F.format_number(value, 2)

    head = F.when(key % 11 == 0, F.lit("ab")).otherwise(vendor)
    invoice = F.concat(
        F.lit("Invoice Number: INV-"), key.cast("string"),
        F.lit("\nBill To: Account "), F.col("o_custkey").cast("string"),
    )
    receipt = F.concat(
        F.lit("Receipt "), key.cast("string"), F.lit("\nTerminal 12 Cash 500.00 Change Due: 3.50")
    )
    body = by(
        7, invoice, invoice, invoice, F.lit("Tax invoice"), receipt, receipt,
        F.lit("Statement of account"),
    )
    date_line = by(
        6,
        F.concat(F.lit("Invoice Date: "), F.date_format(day, "MM/dd/yyyy")),
        F.concat(F.lit("Date: "), F.date_format(day, "yyyy-MM-dd")),
        F.concat(F.lit("Dated: "), F.date_format(day, "MMM d, yyyy")),
        F.concat(F.lit("Bill Date: "), F.date_format(day, "M/d/yy")),
        F.concat(F.lit("Issued "), F.date_format(day, "d/M/yyyy")),
        F.lit("Period without a day"),
    )
    due_line = F.concat(F.lit("Due Date: "), F.date_format(F.date_add(day, 30), "MM/dd/yyyy"))
    full = F.concat(
        F.lit("Subtotal: $"), money(F.floor(price * 0.9)),
        F.lit("\nTax: $"), money(F.floor(price * 0.1)),
        F.lit("\nTotal: $"), money(price),
    )
    plain = F.concat(F.lit("Total: "), price.cast("decimal(12,2)").cast("string"))
    total_line = by(9, plain, F.lit("Thank you"), full, full, full, full, full, full, full)
    return F.concat_ws("\n", head, body, date_line, due_line, total_line)


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of a bill per order, without a join."""
    vendor = F.concat(F.lit("Trading House "), F.col("o_custkey").cast("string"))
    return orders_of_bills(spark, sf_dir).select(
        F.col("o_orderkey").alias("doc_id"), bill_text(vendor).alias("text")
    )


def customer_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills headed by the customer name, with the values they were made from."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    # A shuffled join of narrow rows ends in few tasks, too few for what bills are searched for.
    return joined.repartition(spread_tasks(orders)).select(
        F.col("o_orderkey").alias("doc_id"),
        file_name(F.col("o_orderkey")).alias("file_path"),
        bill_text(F.col("c_name")).alias("text"),
        F.col("c_name").alias("vendor_name"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_totalprice").alias("total_amount"),
    )


def file_name(key: Column) -> Column:
    return F.concat(F.lit("bill_"), key.cast("string"), F.lit(".jpg"))


def bill_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth for the bills, some values missing, some files labelled twice or unknown."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("o_orderkey")
    labels = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.cast("string").alias("doc_id"),
        F.when(key % 17 == 0, F.lit("missing.jpg")).otherwise(file_name(key)).alias("file_path"),
        F.when(key % 10 != 3, F.upper("c_name")).alias("vendor_name"),
        F.when(key % 10 != 4, F.col("o_orderdate").cast("date")).alias("invoice_date"),
        F.when(key % 10 != 5, F.col("o_totalprice")).alias("total_amount"),
        F.when(key % 7 < 4, " Invoice ").otherwise("receipt").alias("doc_type"),
    )
    again = labels.filter(F.col("doc_id").cast("bigint") % 13 == 0)
    return labels.unionByName(again)


def bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bills as evaluated files: first page the bill, timing, every 19th failed."""
    key = F.col("doc_id")
    return customer_bills(spark, sf_dir).select(
        "file_path",
        F.lit(0).alias("page"),
        "text",
        (key % 19 != 0).alias("success"),
        (key % 40).cast("double").alias("preprocessing_ms"),
        F.lit(99.9).alias("overhead_reduction_pct"),
    )


def bounded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in tasks whose tokens fit their memory, for a shuffle of the texts.

    Tokens take thirty times the room of their text, and a task holds its own to shuffle them.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = documents.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    slots = spark.sparkContext.defaultParallelism
    tasks = max(slots, math.ceil(size / TOKENIZED_BYTES))
    few = documents.rdd.getNumPartitions() < tasks
    return documents.repartition(tasks) if few else documents


def word_tokens(spark: SparkSession, sf_dir: str, bounded: bool = False) -> DataFrame:
    """Every word of every document as a token on pages of 200 words.

    Coordinates follow from the word position so that reading order differs from word order
    and some tokens share a corner. ``bounded`` is for tokens of which much is shuffled.
    """
    if bounded:
        documents = bounded_documents(spark, sf_dir)
    else:
        documents = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    words = settle(documents.withColumnRenamed("text", "full"), words=F.split("full", " ")).select(
        "doc_id", F.posexplode("words").alias("pos", "text")
    )
    on_page = F.col("pos") % WORDS_PER_PAGE
    y = F.floor(on_page / 10).cast("int") * 12
    x = (F.col("pos") * 7 % 5) * 50
    corner = F.struct(x.cast("int").alias("x"), y.alias("y"))
    return words.select(
        "doc_id",
        F.floor(F.col("pos") / WORDS_PER_PAGE).cast("int").alias("page"),
        F.lit("easyocr").alias("engine"),
        F.col("pos").alias("seq"),
        "text",
        F.lit(0.9).alias("confidence"),
        F.array(corner, corner, corner, corner).alias("bbox"),
    )


def token_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Over how many tasks tokens are dealt, in proportion to the documents; they take more room."""
    return 2 * spread_tasks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def token_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages ``word_tokens`` covers."""
    last = F.floor((F.size(F.split("text", " ")) - 1) / WORDS_PER_PAGE).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.sequence(F.lit(0), last)).alias("page")
    )


def two_engines(
    spark: SparkSession, sf_dir: str, bounded: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Primary tokens with a fifth of the pages empty, secondary with a fifteenth empty."""
    tokens = word_tokens(spark, sf_dir, bounded)
    page_no = F.col("doc_id") + F.col("page")
    primary = tokens.filter(page_no % 5 != 0)
    secondary = tokens.filter(page_no % 15 != 0).withColumn("text", F.lower("text"))
    return primary, secondary


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of a page per turn, a token per word in reading order."""
    words = F.transform(
        F.split("text", " "),
        lambda word, at: F.struct(
            word.alias("text"), F.lit(0.9).alias("confidence"),
            F.array_repeat(F.struct(F.lit(0).alias("x"), at.cast("int").alias("y")), 4).alias("bbox"),
        ),
    )
    page = F.struct(
        F.col("turn").cast("int").alias("page"),
        F.lit("easyocr").alias("engine"),
        words.alias("tokens"),
    )
    # A conversation is a document, which is one row by definition.
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(page)).alias("pages")
    )


def xml_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML image element per order with two boxes, a polygon, a polyline and a stub."""
    key, w = F.col("o_orderkey"), (F.col("o_custkey") % 300).cast("string")
    element = F.concat(
        F.lit('<image id="'), key.cast("string"), F.lit('" name="img_'), key.cast("string"),
        F.lit('.jpg" width="640" height="480"><box label="invoice" xtl="10" ytl="20.5" xbr="'),
        w, F.lit('" ybr="460" occluded="'), (key % 2).cast("string"),
        F.lit('"><attribute name="status">'), F.col("o_orderstatus"),
        F.lit('</attribute></box><box label="field" ytl="1" xbr="2" ybr="3"/>'
              '<polygon label="stamp" points="100,100;'), w,
        F.lit(',100;150,'), w, F.lit('"/><polyline points="5,5;7,9"/>'
                                    '<polygon label="dot" points="5,5"/></image>'),
    )
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(element.alias("xml"))


def xml_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML track element per part with two boxes."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    element = F.concat(
        F.lit('<track id="'), key, F.lit('" label="'), F.lower("p_type"),
        F.lit('" source="manual"><box frame="'), size,
        F.lit('" outside="1" xtl="1" ytl="2" xbr="3" ybr="4"/><box xtl="'), size,
        F.lit('" ytl="0" xbr="9" ybr="9"/></track>'),
    )
    return table(spark, sf_dir, "part").select(element.alias("xml"))


def json_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON task per order with a rectangle, a polygon and a taxonomy result."""
    key, k10 = F.col("o_orderkey"), F.col("o_custkey") % 50
    s = key.cast("string")
    image = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("img_"), s))
    labels = F.when(key % 4 == 0, F.lit("[]")).otherwise(F.lit('["invoice","other"]'))
    taxonomy = (
        F.when(key % 5 == 0, F.lit("{}"))
        .when(key % 5 == 1, F.lit('{"taxonomy":[]}'))
        .otherwise(F.concat(F.lit('{"taxonomy":[["a","'), F.col("o_orderstatus"),
                            F.lit('"],["c"],[]]}')))
    )
    task = F.concat(
        F.lit('{"id":'), s, F.lit(',"data":{"image":"'), image, F.lit('","ocr":"ocr_'), s,
        F.lit('"},"annotations":[{"result":[{"type":"rectanglelabels","original_width":640,'
              '"original_height":480,"value":{"x":'), k10.cast("string"),
        F.lit(',"y":4,"width":50,"height":92,"rectanglelabels":'), labels,
        F.lit('}},{"type":"polygonlabels","original_width":200,"original_height":100,"value":'
              '{"polygonlabels":["stamp"],"points":[[1,2],['), k10.cast("string"),
        F.lit(',50]]}},{"type":"polygonlabels","value":{"points":[[1,2]]}},'
              '{"type":"choices","value":{}},{"type":"taxonomy","value":'), taxonomy,
        F.lit("}]}]}"),
    )
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(task.alias("json"))


def _damaged(element: Column, key: Column, *changes: tuple[int, str, str]) -> Column:
    """``element`` with a text replaced by another wherever a number divides the key."""
    for modulus, text, other in changes:
        replaced = F.replace(element, F.lit(text), F.lit(other))
        element = F.when(key % modulus == 0, replaced).otherwise(element)
    return element


def numbered(before: str, number: Column, after: str) -> Column:
    """A name with a number in it, without a formatter for each row."""
    text = F.coalesce(number.cast("string"), F.lit("null"))
    return F.concat(F.lit(before), text, F.lit(after))


def write_xml_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The image and track elements as files, some with numbers that cannot be read."""
    image_id = F.regexp_extract("xml", 'id="([0-9]+)"', 1).cast("bigint")
    images = _damaged(
        F.col("xml"), image_id, (31, 'ybr="460"', 'ybr="4x60"'), (37, "5,5;7,9", "5,5;x,9"),
        (41, 'height="480"', 'height="tall"'),
    )
    tracks = _damaged(F.col("xml"), image_id, (29, 'xbr="3"', 'xbr="three"'))
    number = F.floor(image_id / ITEMS_PER_FILE)
    elements = xml_images(spark, sf_dir).select(
        images.alias("xml"), numbered("images_", number, ".xml").alias("name")
    ).unionByName(
        xml_tracks(spark, sf_dir).select(
            tracks.alias("xml"), numbered("tracks_", number, ".xml").alias("name")
        )
    )
    files = elements.groupBy("name").agg(F.array_join(F.collect_list("xml"), "\n").alias("all"))
    head = F.lit('<?xml version="1.0"?>\n<annotations>\n')
    whole = F.concat(head, "all", F.lit("\n</annotations>"))
    store_files(files.select("name", whole.cast("binary").alias("content")), path)


def write_task_arrays(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The tasks as files of one JSON array each, some with numbers that cannot be read."""
    key = F.get_json_object("json", "$.id").cast("bigint")
    damaged = _damaged(
        F.col("json"), key, (31, '"width":50', '"width":"bad"'), (37, "[[1,2],[", '[["x",2],['),
        (41, '"original_height":480', '"original_height":"tall"'),
    )
    tasks = json_tasks(spark, sf_dir).select(damaged.alias("json"), key.alias("key"))
    files = tasks.groupBy(F.floor(F.col("key") / ITEMS_PER_FILE).alias("n")).agg(
        F.array_join(F.collect_list("json"), " ,\n").alias("all")
    )
    store_files(
        files.select(
            F.format_string("tasks_%d.json", "n").alias("name"),
            F.encode(F.concat(F.lit("[\n"), "all", F.lit("\n]\n")), "UTF-8").alias("content"),
        ),
        path,
    )


def write_label_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Box-text files by supplier, a third of them with names that begin with a mark."""
    key = F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.when(key % 3 == 0, "_").when(key % 3 == 1, ".").otherwise(""),
            F.lit("img"), key.cast("string"), F.lit(".txt"),
        ).alias("name"),
        F.concat_ws(
            " ", F.col("l_linenumber").cast("string"), (F.col("l_quantity") / 100).cast("string"),
            F.lit("0.5"), F.lit("0.25"),
            F.when(F.col("l_orderkey") % 23 == 0, "wide").otherwise("0.125"),
        ).alias("line"),
    )
    files = lines.groupBy("name").agg(F.array_join(F.collect_list("line"), "\r\n").alias("all"))
    store_files(files.select("name", F.encode("all", "UTF-8").alias("content")), path)


def write_page_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The pages as files of several kinds in several folders, the html as their content."""
    endings = [".jpg", ".PNG", ".mp4", ".pdf", "", ".tar.webp", ".zip"]
    key = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (key % 7 + 1).cast("int"))
    name = F.concat(
        F.lit("d"), (key % 10).cast("string"), F.lit("/"), F.when(key % 4 == 0, "_").otherwise("p"),
        key.cast("string"), ending,
    )
    store_files(
        table(spark, sf_dir, "pages").select(
            name.alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content")
        ),
        path,
    )


DOCUMENTS_PER_ARCHIVE = 100


def write_archives(spark: SparkSession, sf_dir: str, path: str) -> None:
    """ZIP files of up to 100 documents each, and some that are damaged.

    The worker that packs an archive writes it: a task's archives would reach another worker in
    batches that grow with the input.
    """

    def pack(whole: pa.Table) -> pa.Table:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for key, text in zip(whole["doc_id"].to_pylist(), whole["text"].to_pylist()):
                method = zipfile.ZIP_DEFLATED if key % 2 else zipfile.ZIP_STORED
                archive.writestr(f"p{key % 3}/{key}.png", text, method)
                archive.writestr(f"{key}.txt", text)
        number = whole["n"][0].as_py()
        content = buffer.getbuffer()
        kept = len(content) // 2 if number % 5 == 4 else len(content)
        store_file(path, f"batch_{number}.zip", content[:kept])
        return pa.table({"files": pa.array([1], pa.int64())})

    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.floor(F.col("doc_id") / DOCUMENTS_PER_ARCHIVE).alias("n")
    )
    rows.groupBy("n").applyInArrow(pack, "files BIGINT").agg(F.sum("files")).collect()


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box-text line per line item; the order is the image, every 23rd line lacks a field."""
    key = F.col("l_orderkey")
    text = F.concat_ws(
        " ",
        F.col("l_linenumber").cast("string"),
        (F.col("l_quantity") / 100).cast("string"),
        F.lit("0.5"),
        F.lit("0.25"),
        F.when(key % 23 != 0, F.lit("0.125 7")),
    )
    lines = spread_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"
    )
    return lines.select(
        F.concat(F.lit("img"), key.cast("string")).alias("stem"), text.alias("value")
    )


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files of half the orders, some in two formats."""
    key = F.col("o_orderkey")
    sized = table(spark, sf_dir, "orders").filter(key % 2 == 0)
    ext = F.explode(
        F.when(key % 4 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).otherwise(
            F.array(F.lit(".bmp"))
        )
    )
    stem = F.concat(F.lit("img"), key.cast("string"))
    return sized.select(key, stem.alias("stem"), ext.alias("ext")).select(
        "stem", "ext",
        F.concat(F.lit("/images/"), "stem", "ext").alias("path"),
        F.when(F.col("ext") == ".jpg", 200).otherwise(640).alias("width"),
        F.lit(100).alias("height"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests."""
    return table(spark, sf_dir, "events").select(*request_columns())


def request_columns() -> list[Column]:
    return [
        F.col("ts"), F.col("event_id"), F.lit("POST").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        (F.col("value") * 20).alias("elapsed_ms"),
    ]


def whole_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with whole milliseconds, whose sums are exact."""
    return requests(spark, sf_dir).withColumn("elapsed_ms", F.floor("elapsed_ms").cast("double"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such requests by the third of the month they arrive in; every 40th comes a third later."""
    third = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    late = (F.col("event_id") % 40 == 0).cast("int")
    return whole_requests(spark, sf_dir).withColumn("part", F.least(third + late, F.lit(2)))


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as document results; error events failed."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        (F.col("event_type") != "error").alias("success"),
        F.round(F.col("value") * 20, 2).alias("total_ms"),
        seconds.alias("started_at"), seconds.alias("finished_at"),
    )


ARCHIVE_BATCH_BYTES = 4 * 1024 * 1024


def _zip_bytes(text: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name in ("b.png", "notes.txt", "sub/a.JPG", "c.pdf"):
            archive.writestr(name, f"{name}|{text}")
    return buffer.getvalue()


def pack_archives(batches):
    for batch in batches:
        keys, contents, size = [], [], 0
        for key, text in zip(batch.column("doc_id"), batch.column("text")):
            keys.append(key.as_py())
            contents.append(b"broken" if keys[-1] % 50 == 0 else _zip_bytes(text.as_py()))
            size += len(contents[-1])
            # Archives leave in small batches, however many rows came in.
            if size >= ARCHIVE_BATCH_BYTES:
                yield _packed(keys, contents)
                keys, contents, size = [], [], 0
        if keys:
            yield _packed(keys, contents)


def _packed(keys, contents):
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"doc_{key}.zip" for key in keys], pa.string()),
            pa.array([len(c) for c in contents], pa.int64()),
            pa.array(contents, pa.binary()),
        ],
        names=["path", "length", "content"],
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP archive per document, every 50th broken; whole texts inside."""
    documents = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return documents.mapInArrow(pack_archives, "path STRING, length BIGINT, content BINARY")
