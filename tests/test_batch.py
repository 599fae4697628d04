from folioflow.operators.documents import OCR_RESULT, first_with_tokens, map_documents
from folioflow.operators.reports import NO_FILES, batch_report
from folioflow.operators.tokens import read_pages, token_rows
from folioflow.plans.batch import directory_items, process_items
from folioflow.sources.files import read_files


def size_of(row, task):
    return {"size": -1 if row["content"] is None else len(row["content"])}


def test_directory_batch(spark, tmp_path):
    for name in ("a.jpg", "b.png", "v.mp4", "w.avi", "n.pdf"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    files = read_files(spark, str(tmp_path))
    video = files.filter("path LIKE '%v.mp4'").first().path
    counts = spark.createDataFrame([(video, 23)], "path STRING, total_frames INT")
    items = directory_items(files, counts)
    frames = {r.source_path: r.frame_idx for r in items.filter("frame_idx IS NOT NULL").collect()}
    assert frames == {f"{video}::frame_{i}": i * 4 for i in range(5)}
    results = process_items(items, size_of, "size INT", tasks=3)
    sizes = {r.source_path.rsplit("/", 1)[1]: r.size for r in results.collect()}
    assert sizes["a.jpg"] == 15 and sizes["v.mp4::frame_4"] == -1 and len(sizes) == 7
    assert batch_report(results).first().total_documents == 7
    assert directory_items(files).count() == 2


def test_directory_without_images(spark, tmp_path):
    (tmp_path / "n.pdf").write_bytes(b"x")
    items = directory_items(read_files(spark, str(tmp_path)))
    report = batch_report(process_items(items, size_of, "size INT")).first()
    assert report.total_documents == 0 and report.error == NO_FILES


def first_engine(row, task):
    if row["page"] == 1:
        raise RuntimeError("engine crashed")
    if row["page"] == 2:
        return []
    corner = {"x": 0, "y": 0}
    return [{"text": t, "confidence": 0.5, "bbox": [corner] * 4} for t in ("one", "two")]


def second_engine(row, task):
    if row["page"] == 2:
        raise RuntimeError("engine crashed too")
    return [{"text": "rescued", "confidence": 0.4, "bbox": [{"x": 1, "y": 1}] * 4}]


def test_engines_with_fallback(spark):
    pages = spark.createDataFrame([("d", p) for p in range(3)], "doc_id STRING, page INT")
    results = map_documents(
        pages, first_with_tokens(first_engine, second_engine), OCR_RESULT, keep=("doc_id", "page"))
    rows = {r.page: r for r in results.collect()}
    assert [rows[p].engine for p in range(3)] == ["easyocr"] + ["tesseract_fallback"] * 2
    assert rows[2].success and rows[2].tokens == []
    texts = {r.page: r.full_text for r in read_pages(token_rows(results)).collect()}
    assert texts == {0: "one two", 1: "rescued"}
