import io
import zipfile

import pytest

from catalogue import inputs


def test_archives_are_written_where_they_are_packed(spark, tmp_path, monkeypatch):
    """They reach no second worker, in batches of as many archives as a task has."""

    def travel(*_):
        raise AssertionError("the archives travel as rows")

    monkeypatch.setattr(inputs, "store_files", travel)
    rows = [(i, f"text {i} é" if i % 3 else "") for i in (0, 1, 2, 99, 100, 101, 450, 451)]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(
        str(folder / "documents.parquet"))
    out = tmp_path / "out"
    inputs.write_archives(spark, str(folder), f"file://{out}")
    assert sorted(f.name for f in out.iterdir()) == ["batch_0.zip", "batch_1.zip", "batch_4.zip"]
    read = {}
    for n in (0, 1):
        with zipfile.ZipFile(io.BytesIO((out / f"batch_{n}.zip").read_bytes())) as archive:
            read |= {name: archive.read(name).decode() for name in archive.namelist()}
    expected = {f"p{i % 3}/{i}.png": text for i, text in rows if i < 200}
    assert read == expected | {f"{i}.txt": text for i, text in rows if i < 200}
    with pytest.raises(zipfile.BadZipFile):
        zipfile.ZipFile(io.BytesIO((out / "batch_4.zip").read_bytes()))
