import datetime

import pytest
from pyspark.sql import functions as F

from folioflow.functions.amounts import amount_candidates, total_amount
from folioflow.functions.classify import classify
from folioflow.functions.dates import date_candidates, invoice_date
from folioflow.functions.strings import strip
from folioflow.functions.summary import NO_SUMMARY, summarize
from folioflow.functions.vendor import first_line, known_name, vendor
from folioflow.plans.extract import extract_documents, extract_fields


CLASSIFY_CASES = [
    ("INVOICE\nDue Date: x\nBill To: y", ("invoice", 0.8)),
    ("receipt change due cash terminal pos", ("receipt", 0.99)),
    ("hello world", ("unknown", 0.0)),
    ("", ("unknown", 0.0)),
    (None, ("unknown", 0.0)),
    ("invoice receipt", ("invoice", 0.5)),
    ("bank deposit", ("receipt", 0.6)),
    ("invoice number 7", ("invoice", 0.7)),
]


def test_classify(spark, evaluate_text):
    texts = [case[0] for case in CLASSIFY_CASES]
    for case, found in zip(CLASSIFY_CASES, evaluate_text(classify("text"), *texts)):
        assert found.doc_type == case[1][0], case
        assert found.confidence == pytest.approx(case[1][1], abs=1e-12), case


def test_classify_word_boundary(spark, evaluate_text):
    found = evaluate_text(classify("text", word_boundary=True), "bank deposit", "inv# 7", "pos 1")
    assert [f.doc_type for f in found] == ["unknown", "invoice", "receipt"]


def day(*parts):
    return datetime.date(*parts)


INVOICE_DATE_CASES = [
    ("Invoice Date: 2024-03-15\nDue: 2024-04-15", day(2024, 3, 15), 0.9),
    ("Due: 2024-04-15 Dated: 2024-03-15", day(2024, 3, 15), 0.9),
    ("first 2024-04-15 then 2024-03-15", day(2024, 4, 15), 0.5),
    ("due date: 01/02/2024 invoice date 03/04/2024", day(2024, 1, 2), 0.9),
    ("03/15/2024", day(2024, 3, 15), 0.5),
    ("15/03/2024", day(2024, 3, 15), 0.5),
    ("15-3-24", day(2024, 3, 15), 0.5),
    ("3/4/68", day(2068, 3, 4), 0.5),
    ("3/4/69", day(1969, 3, 4), 0.5),
    ("3/4/202x", None, 0.0),
    ("on Mar 5, 2024", day(2024, 3, 5), 0.5),
    ("mar 5, 2024", day(2024, 3, 5), 0.5),
    ("January 5, 2024", None, 0.0),
    ("99/99/2024", None, 0.0),
    ("02/30/2024 or 02/29/2024", day(2024, 2, 29), 0.5),
    ("date:" + "x" * 15 + "2024-01-02", day(2024, 1, 2), 0.9),
    ("date:" + "x" * 16 + "2024-01-02", day(2024, 1, 2), 0.5),
    ("", None, 0.0),
    (None, None, 0.0),
]


def test_invoice_date(spark, evaluate_text):
    texts = [case[0] for case in INVOICE_DATE_CASES]
    for case, found in zip(INVOICE_DATE_CASES, evaluate_text(invoice_date("text"), *texts)):
        assert (found.value, found.confidence) == case[1:], case


def test_date_candidates_do_not_overlap(spark, evaluate_text):
    (found,) = evaluate_text(date_candidates("text"), "1/2/2024/5/6 2024-5-6")
    assert [c.value for c in found] == [day(2024, 1, 2), day(2024, 5, 6)]


TOTAL_AMOUNT_CASES = [
    ("Subtotal: $80.00\nTax: $8.00\nTotal: $88.00", 88.0, 0.9),
    ("Total: $1,200.00", 1200.0, 0.9),
    ("Total: 1250.00", 125.0, 0.9),
    ("price 12 and 7", 12.0, 0.5),
    ("0.00 and 0", None, 0.0),
    ("amount due" + "x" * 30 + "5", 5.0, 0.9),
    ("amount due" + "x" * 31 + "5", 5.0, 0.5),
    ("amount due" + "x" * 30 + "€ 5", 5.0, 0.9),
    ("amount due" + "x" * 31 + "€ 5", 5.0, 0.5),
    ("GRAND TOTAL £ 1,000,000.25", 1000000.25, 0.9),
    ("9" * 3 + " before total 1", 1.0, 0.9),
    ("", None, 0.0),
    (None, None, 0.0),
]


def test_total_amount(spark, evaluate_text):
    texts = [case[0] for case in TOTAL_AMOUNT_CASES]
    for case, found in zip(TOTAL_AMOUNT_CASES, evaluate_text(total_amount("text"), *texts)):
        assert (found.value, found.confidence) == case[1:], case
        assert found.currency == (None if found.value is None else "USD")


def test_amount_options(spark, evaluate_text):
    text = "Subtotal: 1250.00" + " " * 45 + "Total: 1300.50"
    plain = evaluate_text(total_amount("text", plain_digits=True), text)[0]
    assert (plain.value, plain.confidence) == (1300.5, 0.9)
    (scores,) = evaluate_text(
        amount_candidates("text", plain_digits=True, penalise_subtotal=True), text
    )
    assert [(c.score, c.value) for c in scores] == [(0.3, 1250.0), (0.9, 1300.5)]


FIRST_LINE_CASES = [
    ("Green Garden\nInvoice", "Green Garden"),
    ("abc\n  \n \t Barn House \r\nrest", "Barn House"),
    ("abc\nabcd", "abcd"),
    ("abc", None),
    ("\xa0 Menu Co\xa0\nx", "Menu Co"),
    ("no newline at all 1 2 3", "no newline at all 1 2 3"),
    ("", None),
    (None, None),
]


def test_first_line(spark, evaluate_text):
    texts = [case[0] for case in FIRST_LINE_CASES]
    assert evaluate_text(first_line("text"), *texts) == [case[1] for case in FIRST_LINE_CASES]


def test_known_names(spark, evaluate_text):
    names = ["Green Garden", "Green Garden Ltd.", "Burger Barn", "A.B. Foods"]
    texts = [
        "hello (GREEN   garden) and Burger Barn",
        "to green garden\nLtd, x",
        "evergreen garden",
        "x" * 600 + " Burger Barn",
        "from a.b. foods",
        None,
    ]
    assert evaluate_text(known_name("text", names), *texts) == [
        "Green Garden", "Green Garden Ltd.", None, None, "A.B. Foods", None,
    ]
    many = [f"name {i}" for i in range(1000)]
    assert evaluate_text(known_name("text", many), "to Name 7, by name 999") == ["name 7"]
    cut = "x " * 248 + "Johnson Ltd"
    assert cut[:500].endswith("John")
    assert evaluate_text(known_name("text", ["John", "x"]), cut[2:], cut) == ["x", "x"]
    assert evaluate_text(known_name("text", ["John"]), cut) == [None]


def test_vendor_confidence(spark, evaluate_text):
    found = evaluate_text(vendor("text", known_name("text", ["Barn"])), "at the Barn", "other", "a")
    assert [tuple(f) for f in found] == [("Barn", 0.8), ("other", 0.4), (None, 0.0)]


LONG = "This sentence has no figure in it"
FIGURE = "This sentence has the figure 7 in it"


SUMMARY_CASES = [
    (f"{LONG}. {FIGURE}! short? {LONG} b\n{FIGURE} b.{FIGURE} c.{FIGURE} d",
     [FIGURE, f"{FIGURE} b", f"{FIGURE} c"]),
    (f"{LONG}. {FIGURE}. {LONG} b. {LONG} c", [FIGURE, LONG, f"{LONG} b"]),
    ("x" * 20 + ". " + "y" * 21, ["y" * 21]),
    (f"{FIGURE} costs $1,250.00 in all", [f"{FIGURE} costs $1,250"]),
    ("x" * 25 + "٣", ["x" * 25 + "٣"]),
    ("", [NO_SUMMARY]),
    (None, [NO_SUMMARY]),
]


def test_summary(spark, evaluate_text):
    texts = [case[0] for case in SUMMARY_CASES]
    for case, found in zip(SUMMARY_CASES, evaluate_text(summarize("text"), *texts)):
        assert found == case[1], case


def test_long_texts(spark):
    texts = [
        "1" + ",234" * 100_000 + " total 5",
        "9" * 300_000,
        " " * 300_000 + "x" * 200_000,
        "1/" * 150_000 + "2/2024",
        "-" * 200_000 + "a. " + "word 7 " * 60_000,
        "total " * 60_000 + "12",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    known = known_name("text", ["Burger Barn"])
    rows = extract_documents(frame, known_vendor=known).orderBy("doc_id").collect()
    amounts = [r.fields.total_amount for r in rows]
    assert (amounts[0].value, amounts[0].confidence) == (5.0, 0.9)
    assert (amounts[1].value, amounts[5].value, amounts[5].confidence) == (999.0, 12.0, 0.9)
    assert rows[2].fields.vendor_name.value == "x" * 200_000
    assert rows[3].fields.invoice_date.value == day(2024, 1, 2)
    assert rows[4].summary == [("word 7 " * 60_000).strip(), "-" * 200_000 + "a"]


def test_strip_is_unicode_aware(spark, evaluate_text):
    texts = ["\x1c　 a b \x85 ", "​"]
    assert evaluate_text(strip("text"), *texts) == [t.strip() for t in texts]


def test_fields_and_response(spark):
    text = "Green Garden Restaurant\nDate: 2024-01-20\nTotal: $1,200.00"
    frame = spark.createDataFrame([("d1", text), ("d2", "")], "doc_id STRING, text STRING")
    fields = frame.select(extract_fields("text").alias("f")).first().f
    assert tuple(fields.vendor_name) == ("Green Garden Restaurant", 0.4)
    assert tuple(fields.invoice_date) == (day(2024, 1, 20), 0.9)
    assert tuple(fields.total_amount) == (1200.0, "USD", 0.9)

    first, second = extract_documents(frame).orderBy("doc_id").collect()
    assert first.errors == [] and first.debug.pages == 1
    assert second.doc_type == "unknown" and second.summary == [NO_SUMMARY]
    assert tuple(second.fields.total_amount) == (None, None, 0.0)
    assert '"summary"' in extract_documents(frame).select(F.to_json(F.struct("*"))).first()[0]
