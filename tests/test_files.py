import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalogue.inputs import ARCHIVE_BATCH_BYTES, pack_archives
from folioflow.operators.documents import (
    document_id, map_documents, number_documents, spread_documents,
)
from folioflow.plans.extract import extract_documents
from folioflow.sources.archives import expand_archives
from folioflow.sources.files import (
    check_archives, discover, extension, read_files, read_labels, route_media,
    spread_scan,
)
from folioflow.sources.sinks import write_artifacts, write_report


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "b.pdf", "c.mkv", "sub/d.webp", "sub/e.txt", "noext"):
        (tmp_path / name).write_bytes(b"123")
    found = discover(read_files(spark, str(tmp_path)))
    rows = {(r.name, r.kind) for r in found.orderBy("directory", "name").collect()}
    assert rows == {("a.JPG", "image"), ("c.mkv", "video"), ("d.webp", "image")}
    assert read_files(spark, str(tmp_path), "*.pdf").count() == 1
    with pytest.raises(AnalysisException):
        read_files(spark, str(tmp_path / "gone")).collect()


def test_extension(spark):
    cases = {"/a/b.JPG": ".jpg", "/a.b/c": "", "/.jpg": "", "/a/..png": "", "x.tar.gz": ".gz",
             "/x.": ".", "": ""}
    frame = spark.createDataFrame([(k,) for k in cases], "path STRING")
    assert [r[0] for r in frame.select(extension("path")).collect()] == list(cases.values())


def test_routing(spark):
    cases = [("x.png", "application/pdf", "pdf"), ("x.pdf", "image/png", "image"),
             ("x.PDF", None, "pdf"), ("x.pdf", "text/plain", "pdf"), ("x", None, "image"),
             ("x.mp4", "", "image")]
    frame = spark.createDataFrame([c[:2] for c in cases], "path STRING, content_type STRING")
    assert [r.kind for r in route_media(frame).collect()] == [c[2] for c in cases]


def test_upload_checks(spark):
    frame = spark.createDataFrame(
        [("a.ZIP", 5), ("b.rar", 5), ("c.zip", 0), (None, 1), ("d.zip", 1 << 31)],
        "path STRING, length BIGINT")
    bad = {"b.rar": "not_zip", "c.zip": "empty", None: "not_zip"}
    accepted, rejected = check_archives(frame)
    assert [r.path for r in accepted.collect()] == ["a.ZIP", "d.zip"]
    assert {r.path: r.reason for r in rejected.collect()} == bad
    # As a value of a column an archive must fit one.
    accepted, rejected = check_archives(frame.withColumn("content", F.lit(b"")))
    assert [r.path for r in accepted.collect()] == ["a.ZIP"]
    assert {r.path: r.reason for r in rejected.collect()} == {**bad, "d.zip": "too_large"}


def archive(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as packed:
        for name, content in members.items():
            packed.writestr(name, content)
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    good = archive({"z.png": b"zz", "a.JPG": b"aa", "n.pdf": b"n", "v.mp4": b"v",
                    "big.bmp": b"x" * 5_000_000})
    broken = bytearray(archive({"q.png": b"hello hello hello", "r.png": b"fine"}))
    at = bytes(broken).index(b"hello hello")
    broken[at] ^= 0xFF
    for name, content in (("good.zip", good), ("bad.zip", b"not a zip"), ("crc.zip", bytes(broken)),
                          ("none.zip", archive({"a.txt": b"t"}))):
        (tmp_path / name).write_bytes(content)
    files = read_files(spark, str(tmp_path), "*.zip")
    for tasks in (None, 3):
        rows = expand_archives(files, tasks=tasks).collect()
        found = {(r.archive.rsplit("/", 1)[1], r.member): r for r in rows}
        assert set(found) == {("good.zip", "a.JPG"), ("good.zip", "big.bmp"), ("good.zip", "z.png"),
                              ("bad.zip", None), ("crc.zip", "q.png"), ("crc.zip", "r.png")}
        assert bytes(found["good.zip", "z.png"].content) == b"zz"
        assert found["good.zip", "z.png"].member_index == 2
        assert len(found["good.zip", "big.bmp"].content) == 5_000_000
        assert found["bad.zip", None].error and found["crc.zip", "q.png"].error
        assert bytes(found["crc.zip", "r.png"].content) == b"fine"


def shout(row, task):
    with task.step("shout"):
        if "bad" in row["text"]:
            raise ValueError("bad page")
        return {"loud": row["text"].upper(), "tags": [{"n": len(row["text"])}]}


def test_guarded_map(spark):
    frame = spark.createDataFrame(
        [("1", "p1", "fine"), ("2", "p2", "bad"), ("3", "p3", "ok")],
        "doc_id STRING, source_path STRING, text STRING")
    schema = "loud STRING, tags ARRAY<STRUCT<n: INT>>, prefix STRING"

    def with_model(row, task):
        return {**shout(row, task), "prefix": task.model}

    done = map_documents(spread_documents(frame, "doc_id", 2), with_model, schema, lambda: "m")
    rows = {r.doc_id: r for r in done.collect()}
    assert rows["1"].loud == "FINE" and rows["1"].prefix == "m" and rows["1"].tags[0].n == 4
    assert rows["1"].success and rows["1"].error is None and "shout" in rows["1"].timings
    assert not rows["2"].success and rows["2"].error == "bad page" and rows["2"].loud is None
    assert rows["2"].total_ms >= 0 and rows["2"].finished_at >= rows["2"].started_at


def test_names_and_ids(spark):
    frame = spark.createDataFrame([(0, None), (1, "x")], "pos INT, source_path STRING")
    named = number_documents(frame, "pos")
    assert [r.source_path for r in named.orderBy("pos").collect()] == ["image_0", "x"]
    ids = named.select(document_id().alias("d"), document_id(random=True).alias("u")).collect()
    assert len({r.d for r in ids}) == 2 and all(len(r.u) == 36 for r in ids)


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(
        "doc_id,file_path,vendor_name,invoice_date,total_amount,doc_type\n"
        "DOC1,a.jpg,Green Garden,2024-01-15,1250.00,invoice\nDOC2,b.jpg,,,,receipt\n")
    first, second = read_labels(spark, str(path)).collect()
    assert (str(first.invoice_date), first.total_amount) == ("2024-01-15", 1250.0)
    assert (second.vendor_name, second.invoice_date, second.total_amount) == (None, None, None)


@pytest.mark.parametrize("options", [{}, {"buckets": 3}, {"file_format": "json"}])
def test_artifacts(spark, tmp_path, options):
    documents = spark.createDataFrame([(str(i), "Acme Foods") for i in range(20)],
                                      "doc_id STRING, text STRING")
    out = str(tmp_path / "out")
    write_artifacts(extract_documents(documents), documents, out, **options)
    stored = spark.read.format(options.get("file_format", "parquet")).load(f"{out}/extractions")
    assert stored.count() == 20 and spark.read.format(
        options.get("file_format", "parquet")).load(f"{out}/pages").count() == 20
    assert {r[0] for r in stored.select("fields.vendor_name.value").collect()} == {"Acme Foods"}


def test_report(spark, tmp_path):
    out = tmp_path / "report"
    write_report(spark.range(1).select(F.lit(0.95).alias("accuracy")), str(out))
    (part,) = out.glob("part-*.json")
    report = json.loads(part.read_text())
    assert report["accuracy"] == 0.95 and "timestamp" in report


def test_tasks_grow_with_the_scan(spark, tmp_path):
    spark.range(100).repartition(6).write.parquet(str(tmp_path / "t"))
    for files in (1, 6):
        paths = sorted(map(str, tmp_path.glob("t/*.parquet")))[:files]
        scan = spark.read.parquet(*paths)
        found = scan.rdd.getNumPartitions()
        assert found < spark.sparkContext.defaultParallelism
        assert spread_scan(scan).rdd.getNumPartitions() == max(8, 8 * found)
        assert sorted(spread_scan(scan).collect()) == sorted(scan.collect())


def test_archives_leave_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": ["x" * 20_000] * 400})
    made = list(pack_archives([batch]))
    assert [p for m in made for p in m["path"].to_pylist()] == [f"doc_{i}.zip" for i in range(400)]
    assert max(sum(m["length"].to_pylist()) for m in made) < 2 * ARCHIVE_BATCH_BYTES
    assert made[0]["content"][0].as_py() == b"broken" and len(made) > 4
