"""Random texts through the Spark expressions and through the SQL definitions."""

import random

import duckdb
import pandas as pd
import pytest

from catalogue import oracles
from folioflow.plans.extract import extract_documents, flatten
from pyspark.sql import functions as F

PIECES = [
    "total", "Total", "subtotal", "GRAND TOTAL", "amount due", "balance due", "invoice date",
    "date:", "Dated:", "bill date", "Due", "invoice", "receipt", "cash", "POS", "inv#",
    "12/31/2023", "1-2-24", "31/12/99", "2024/2/29", "2023-02-29", "Jan 5, 2024", "May\xa07, 2021",
    "ary 5, 2024", "1/2", "12", "1,234.56", "1234567.891", "$ 5.00", "€7", "0.00", "0.01", "₹\t9",
    " ", " ", " ", "\n", "\n", "\xa0", "\r\n", " ", ".", "!", "?", "-", "/", ",", "é", "ß",
    "😀", "lorem ipsum dolor sit amet", "a sentence of some length", "xyz", "x", "٣",
]


def make_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_expressions_agree_with_sql(spark, seed):
    texts = make_texts(800, seed)
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    database = duckdb.connect()
    database.register("documents", frame)
    wanted = database.execute(oracles.ORACLES["extract_corpus"]).df()

    rows = spark.createDataFrame(frame).repartition(4)
    flat = flatten(extract_documents(rows), "doc_id", "classification_confidence", "summary")
    found = flat.withColumn("summary", F.array_join("summary", " | ")).toPandas()

    def plain(table):
        table = table.set_index("doc_id").sort_index()[sorted(wanted.columns.drop("doc_id"))]
        table["date"] = table["date"].map(lambda d: None if pd.isna(d) else str(d)[:10])
        return table.astype(object).where(table.notna(), None)

    mine, theirs = plain(found), plain(wanted)
    differing = [
        (texts[i], mine.loc[i].to_dict(), theirs.loc[i].to_dict())
        for i in mine.index
        if mine.loc[i].to_dict() != theirs.loc[i].to_dict()
    ]
    assert not differing, differing[:2]
