import io
import json
import random
import zipfile

import pytest
from pyspark.errors import AnalysisException

from folioflow.plans.batch import (
    archive_items, archive_problems, directory_items, directory_problems,
)
from folioflow.sources.archives import expand_archive_files, expand_archives, list_members, read_members
from folioflow.sources.files import read_files, stream_files
from folioflow.sources.json_array import State, array_elements, change_of
from folioflow.sources.listing import list_tree, text_lines, with_content
from folioflow.sources.ranges import listed_files, store_files


def archive(members, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as packed:
        for name, content in members:
            packed.writestr(name, content)
    return buffer.getvalue()


def test_members_by_ranges_equal_members_by_content(spark, tmp_path):
    broken = bytearray(archive([("q.png", b"hello hello hello"), ("r.png", b"fine")], zipfile.ZIP_STORED))
    broken[bytes(broken).index(b"hello hello")] ^= 0xFF
    cases = {
        "good.zip": archive([("z.png", b"zz"), ("a.JPG", b"aa" * 9000), ("n.pdf", b"n"), ("e.bmp", b"")]),
        "twice.zip": archive([("a.png", b"first"), ("a.png", b"last")]),
        "other.zip": archive([("b.png", b"packed" * 99)], zipfile.ZIP_BZIP2),
        "bad.zip": b"not a zip", "crc.zip": bytes(broken), "none.zip": archive([("a.txt", b"t")]),
        "cut.zip": archive([("a.png", b"x" * 9)])[:-8],
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    files = read_files(spark, str(tmp_path), "*.zip")

    def found(rows):
        return sorted(
            (r.archive.rsplit("/", 1)[1], r.member or "", r.member_index if r.member else -1,
             None if r.content is None else bytes(r.content), r.error is not None) for r in rows.collect())

    listed = listed_files(spark, str(tmp_path), "*.zip")
    assert "content" not in listed.columns
    assert found(expand_archive_files(listed)) == found(expand_archives(files))
    assert found(expand_archive_files(listed, tasks=5)) == found(expand_archives(files))
    items = archive_items(listed).collect()
    assert sorted(r.doc_id for r in items) == sorted(r.doc_id for r in archive_items(files).collect())
    assert archive_problems(listed).count() == archive_problems(files).count() == 3
    assert expand_archive_files(listed.limit(0)).count() == 0


def test_archives_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.zip"
    with open(path, "wb") as out:
        out.truncate((1 << 31) + 12345)  # a hole, which takes no disk
        out.seek(0, io.SEEK_END)
        out.write(archive([(f"{i}.png", f"content {i}" * 50) for i in range(200)]))
    listed = listed_files(spark, str(tmp_path))
    assert listed.first().length > 1 << 31
    members = list_members(listed)
    assert members.count() == 200 and members.filter("header > 2147483647").count() == 200
    spread = members.repartition(6, "member_index")
    rows = read_members(spread)
    assert {bytes(r.content) for r in rows.collect()} == {f"content {i}".encode() * 50 for i in range(200)}
    assert spread.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).filter(bool).count() == 6
    assert archive_items(listed).count() == 200 and archive_problems(listed).count() == 0


def odd_value(chance, depth=0):
    kind = chance.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(chance.choices('ab"\\[]{},: \né😀\t ', k=chance.randint(0, 12)))
    if kind < 6:
        return chance.choice([None, True, 1.5, -3, 10**12])
    if kind == 6:
        return [odd_value(chance, depth + 1) for _ in range(chance.randint(0, 4))]
    return {f'k"{i}\\': odd_value(chance, depth + 1) for i in range(chance.randint(0, 4))}


@pytest.mark.parametrize("block_bytes, fan", [(7, 3), (64, 4), (1 << 20, 1024)])
def test_array_elements_by_blocks(spark, tmp_path, block_bytes, fan):
    chance = random.Random(block_bytes)
    expected = {}
    for i in range(6):
        values = [odd_value(chance) for _ in range(chance.randint(0, 40))]
        text = json.dumps(values, ensure_ascii=bool(i % 2), indent=[None, 1, "\t"][i % 3])
        (tmp_path / f"f{i}.json").write_bytes((b"\xef\xbb\xbf" if i == 4 else b" \n" * i) + text.encode())
        expected[f"f{i}.json"] = values
    whole = {"annotations": [1, {"a": ["x", "y"]}], "b": [1, 2]}
    (tmp_path / "object.json").write_text("\n" * 20 + json.dumps(whole))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "number.json").write_text("12")
    (tmp_path / "slashes.json").write_text('["' + "\\\\" * 50 + '","a\\"' + "\\\\" * 9 + '"]')
    expected |= {"object.json": [whole], "slashes.json": ["\\" * 50, 'a"' + "\\" * 9]}
    rows = array_elements(spark, str(tmp_path), block_bytes, fan).orderBy("begin").collect()
    found = {name: [] for name in expected}
    for r in rows:
        found[r.file.rsplit("/", 1)[1]].append(json.loads(r.element))
    assert found == expected


def test_changes_compose():
    chance = random.Random(2)
    for _ in range(300):
        data = "".join(chance.choices('"\\[]{},a', k=chance.randint(0, 30))).encode()
        cut = chance.randint(0, len(data))
        left, right = change_of(data[:cut]), change_of(data[cut:])
        assert left.then(right) == change_of(data)
        for inside in (False, True):
            for escape in (False, True):
                state = State(4, inside, escape)
                assert right.after(left.after(state)) == change_of(data).after(state)


def test_many_tasks_share_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "pad": "x" * 100} for i in range(2000)]))
    elements = array_elements(spark, str(tmp_path), 10_000)
    per_task = elements.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(per_task) == 2000 and sum(n > 0 for n in per_task) >= 8 and max(per_task) < 1000


def test_listing_has_hidden_names(spark, tmp_path):
    (tmp_path / "sub" / "_deep").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    names = ["a.txt", "_b.txt", ".c.txt", "sub/d +%20é.txt", "sub/_deep/.e"]
    (tmp_path / "empty.txt").write_bytes(b"")
    for name in names:
        (tmp_path / name).write_bytes(b"one\r\ntwo\rthree\n\nfour \xc3\xa9")
    files = list_tree(spark, f"file://{tmp_path}")
    assert {r.path.split(f"{tmp_path}/")[1] for r in files.collect()} == {"empty.txt", *names}
    assert {r.length for r in files.collect()} == {0, 23}
    assert list_tree(spark, str(tmp_path), recursive=False).count() == 4
    assert {bytes(r.content)[:3] for r in with_content(files).collect()} == {b"", b"one"}
    lines = [r.value for r in text_lines(files.filter("path LIKE '%a.txt'")).collect()]
    assert lines == ["one", "two", "three", "", "four é"]
    assert list_tree(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(AnalysisException):
        list_tree(spark, str(tmp_path / "gone"))


def test_lines_are_read_by_many_tasks(spark, tmp_path):
    texts = {
        "a": b"one\r\ntwo\rthree\n\nfour \xc3\xa9", "b": b"\n\n", "c": b"x" * 50, "d": b"\r\ny\r",
        "e": b"".join(b"%d\n" % i for i in range(300)), "f": b"long" * 9 + b"\n" + b"z\n",
    }
    for name, data in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    files = list_tree(spark, str(tmp_path))
    expected = sorted(map(tuple, text_lines(files).collect()))
    assert sum(path.endswith("e.txt") for path, _ in expected) == 300 and len(expected) == 312
    for size in (1, 2, 7, 64):
        assert sorted(map(tuple, text_lines(files, size).collect())) == expected, size
    per_task = text_lines(files, 64).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(n > 0 for n in per_task) >= 8 and max(per_task) < 150


def test_files_arrive_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name in ("a.png", "b.jpg", "c.pdf"):
        (folder / name).write_bytes(name.encode())
        items = directory_items(stream_files(spark, str(folder)))
        query = items.writeStream.option("checkpointLocation", str(tmp_path / "mark"))
        query.format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    stored = spark.read.parquet(out).collect()
    assert {bytes(r.content) for r in stored} == {b"a.png", b"b.jpg"} and len(stored) == 2


def test_videos_without_frames_are_problems(spark, tmp_path):
    frame = spark.createDataFrame([(n, b"x") for n in ("v.mp4", "w.mp4", "x.mp4", "i.png")], "name STRING, content BINARY")
    store_files(frame, str(tmp_path / "out"))
    files = read_files(spark, str(tmp_path / "out"))
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    counts = spark.createDataFrame([(paths["v.mp4"], 3), (paths["w.mp4"], 0)], "path STRING, total_frames INT")
    problems = {r.path: r.error for r in directory_problems(files, counts).collect()}
    assert problems == {paths["w.mp4"]: "no_frames", paths["x.mp4"]: "no_frame_count"}
    assert directory_items(files, counts).count() == 4
    assert directory_problems(files).count() == 3
