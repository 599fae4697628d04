import zipfile

from folioflow.functions.matching import date_match
from folioflow.operators.documents import map_documents
from folioflow.operators.evaluate import confusion_counts, compare
from folioflow.operators.sampling import newest
from folioflow.sources.archives import expand_archives
from folioflow.sources.files import read_labels
from pyspark.sql import functions as F

LARGE = 9007199254740993


def test_integers_with_nulls_reach_the_function_whole(spark):
    frame = spark.createDataFrame(
        [(LARGE, 3, [1, None]), (None, None, None), (5, 7, [2])],
        "doc_id BIGINT, n INT, parts ARRAY<INT>",
    )

    def look(row, task):
        with task.step("look"):
            if row["n"] == 7:
                return {"kind": "a", "n2": "no number"}
            return {"kind": type(row["n"]).__name__, "n2": row["n"], "m": {"k": 1.5}}

    found = map_documents(frame, look, "kind STRING, n2 INT, m MAP<STRING, DOUBLE>", keep=("doc_id",))
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == {LARGE, None, 5}
    assert (rows[LARGE].kind, rows[LARGE].n2, rows[LARGE].m) == ("int", 3, {"k": 1.5})
    assert (rows[None].kind, rows[None].n2) == ("NoneType", None)
    assert "look" in rows[LARGE].timings
    # A value that does not fit the schema fails its own row only.
    assert not rows[5].success and rows[5].error and rows[LARGE].success


def test_labels_are_read_by_name(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(
        "total_amount,file_path,doc_id,invoice_date,extra\n"
        "12.5,a.jpg,1,2024-01-05,x\nmuch,b.jpg,2,01/05/2024,y\n,c.jpg,3,,z\n"
    )
    rows = {r.doc_id: r for r in read_labels(spark, str(path)).collect()}
    assert rows["1"].file_path == "a.jpg" and rows["1"].total_amount == 12.5
    assert str(rows["1"].invoice_date) == "2024-01-05" and rows["1"].malformed == []
    assert sorted(rows["2"].malformed) == ["invoice_date", "total_amount"]
    assert rows["3"].malformed == [] and rows["3"].vendor_name is None
    predictions = spark.createDataFrame(
        [(f"{n}.jpg", True, None, None, 1.0, "x", 1.0) for n in "abc"],
        "file_path STRING, success BOOLEAN, vendor STRING, date DATE, amount DOUBLE,"
        " doc_type STRING, preprocessing_ms DOUBLE",
    )
    counts = confusion_counts(compare(read_labels(spark, str(path)), predictions)).first()
    assert (counts.date_fn, counts.amount_fn, counts.amount_fp) == (2, 2, 3)


def test_dates_match_stripped(spark):
    frame = spark.createDataFrame([(" 2024-01-05", "2024-01-05 ")], "a STRING, b STRING")
    assert frame.select(date_match("a", "b")).first()[0]
    assert frame.select(date_match(F.col("a").cast("date"), "b")).first()[0]
    assert not frame.select(date_match("a", F.lit(None).cast("string"))).first()[0]


def test_newest_beyond_a_thousand_of_a_hot_group(spark):
    frame = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), "id"
    )
    rows = newest(frame, ["id"], 1001, by=["k"]).collect()
    for key, kept in (("hot", lambda i: i % 3), ("cold", lambda i: not i % 3)):
        assert {r.id for r in rows if r.k == key} == set(
            [i for i in range(6000) if kept(i)][-1001:]
        )


def test_damaged_members_are_rows(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_LZMA) as packed:
        packed.writestr("a.png", b"abc" * 1000)
        packed.writestr("b.png", b"xyz" * 1000)
    content = bytearray(path.read_bytes())
    content[45:60] = bytes(15)
    frame = spark.createDataFrame([("a.zip", bytes(content))], "path STRING, content BINARY")
    rows = {r.member: r for r in expand_archives(frame).collect()}
    assert rows["a.png"].error and rows["a.png"].content is None
    assert bytes(rows["b.png"].content) == b"xyz" * 1000
