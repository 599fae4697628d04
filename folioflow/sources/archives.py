"""Members of ZIP archives as rows."""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.schemas import ARCHIVE_MEMBERS

from .files import IMAGE_EXTENSIONS, MAX_CONTENT_BYTES
from .ranges import opened

_ARROW_MEMBERS = pa.schema(
    [
        ("archive", pa.string()),
        ("member_index", pa.int32()),
        ("member", pa.string()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)


LISTED = (
    "archive STRING, member_index INT, member STRING, header BIGINT, stored_bytes BIGINT,"
    " bytes BIGINT, method INT, flags INT, crc BIGINT, error STRING"
)
_ARROW_LISTED = pa.schema(
    [
        ("archive", pa.string()),
        ("member_index", pa.int32()),
        ("member", pa.string()),
        ("header", pa.int64()),
        ("stored_bytes", pa.int64()),
        ("bytes", pa.int64()),
        ("method", pa.int32()),
        ("flags", pa.int32()),
        ("crc", pa.int64()),
        ("error", pa.string()),
    ]
)
# Fixed values of the ZIP format: a local header's size, signature and place of its two lengths.
_HEADER_BYTES, _HEADER_MARK, _HEADER_LENGTHS = 30, b"PK\x03\x04", 26
_ENCRYPTED = 1
# Bytes of members that a task reads, and tasks at most.
_TASK_BYTES = 128 * 1024 * 1024
_MOST_TASKS = 4096
# Members travel together up to about this size, larger ones alone.
_BATCH_BYTES = 4 * 1024 * 1024


def _members(archive: str, content: bytes, extensions: frozenset[str]) -> Iterator[tuple]:
    try:
        opened = zipfile.ZipFile(io.BytesIO(content))
    except Exception as problem:  # a damaged archive is a row, not a failed job
        yield archive, None, None, None, str(problem) or type(problem).__name__
        return
    with opened:
        wanted = (
            name
            for name in sorted(opened.namelist())
            if os.path.splitext(name)[1].lower() in extensions
        )
        for index, name in enumerate(wanted):
            try:
                yield archive, index, name, opened.read(name), None
            except Exception as problem:  # any damage to one member leaves the others readable
                yield archive, index, name, None, str(problem) or type(problem).__name__


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    pending, size = [], 0
    for row in rows:
        pending.append(dict(zip(_ARROW_MEMBERS.names, row)))
        size += len(row[3] or b"")
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(pending, schema=_ARROW_MEMBERS)
            pending, size = [], 0
    if pending:
        yield pa.RecordBatch.from_pylist(pending, schema=_ARROW_MEMBERS)


def expand_archives(
    archives: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, tasks: int | None = None
) -> DataFrame:
    """``archive, member_index, member, content, error`` for the members with an extension.

    ``archives``: ``path, content``. Members come by name. An archive that cannot be opened
    gives one row with ``error`` and no member; an unreadable member keeps its row with
    ``error`` and no content. Members leave the worker in small batches. ``tasks`` spreads
    them afterwards by archive and member, so one large archive does not stay in one task.
    """
    wanted = frozenset(extensions)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from _batched(_members(path.as_py(), content.as_py() or b"", wanted))

    members = archives.select("path", "content").mapInArrow(expand, ARCHIVE_MEMBERS)
    return members.repartition(tasks, "archive", "member") if tasks else members


def list_members(
    files: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS
) -> DataFrame:
    """A row per member with one of the extensions, from the archives' directories alone.

    ``files``: ``path`` of archives of any size, as ``ranges.listed_files`` gives them. Only the
    directory at an archive's end is read, by ranges. Columns: ``LISTED``; an archive that
    cannot be opened gives one row with ``error`` and no member. Of members with one name the
    last counts, once for each, as when reading by name.
    """
    wanted = frozenset(extensions)

    def rows(path: str) -> Iterator[dict]:
        try:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                names = [
                    n
                    for n in sorted(archive.namelist())
                    if os.path.splitext(n)[1].lower() in wanted
                ]
                for index, name in enumerate(names):
                    info = archive.getinfo(name)
                    yield {
                        "archive": path, "member_index": index, "member": name,
                        "header": info.header_offset, "stored_bytes": info.compress_size,
                        "bytes": info.file_size, "method": info.compress_type,
                        "flags": info.flag_bits, "crc": info.CRC, "error": None,
                    }
        except Exception as problem:  # a damaged archive is a row, not a failed job
            yield {"archive": path, "error": str(problem) or type(problem).__name__}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                pending: list[dict] = []
                for row in rows(path):
                    pending.append(row)
                    if len(pending) == 10_000:
                        yield pa.RecordBatch.from_pylist(pending, schema=_ARROW_LISTED)
                        pending = []
                yield pa.RecordBatch.from_pylist(pending, schema=_ARROW_LISTED)

    return files.select("path").mapInArrow(run, LISTED)


def _member_bytes(file: pa.NativeFile, row: dict) -> bytes:
    """One member's content, checked against its directory entry."""
    if row["flags"] & _ENCRYPTED:
        raise RuntimeError("the member is encrypted")
    if row["bytes"] > MAX_CONTENT_BYTES:
        raise RuntimeError("the member is too large for a binary value")
    if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(file) as archive:
            return archive.read(row["member"])
    file.seek(row["header"])
    head = file.read(_HEADER_BYTES)
    if len(head) < _HEADER_BYTES or not head.startswith(_HEADER_MARK):
        raise zipfile.BadZipFile("the member has no header where its archive says")
    file.seek(row["header"] + _HEADER_BYTES + sum(struct.unpack_from("<HH", head, _HEADER_LENGTHS)))
    content = file.read(row["stored_bytes"])
    if row["method"] == zipfile.ZIP_DEFLATED:
        content = zlib.decompressobj(-zlib.MAX_WBITS).decompress(content, row["bytes"] + 1)
    if len(content) != row["bytes"] or zlib.crc32(content) != row["crc"]:
        raise zipfile.BadZipFile("the member is not what its archive says")
    return content


def read_members(members: DataFrame) -> DataFrame:
    """``archive, member_index, member, content, error`` of the rows of ``list_members``.

    Each member is read on its own by ranges, so the members of one archive spread over the
    tasks that ``members`` has. A member that cannot be read keeps its row with ``error``.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        path, file = None, None
        try:
            for row in batch.to_pylist():
                content, error = None, row["error"]
                if error is None:
                    try:
                        if row["archive"] != path or file is None or file.closed:
                            if file is not None:
                                file.close()
                            path, file = row["archive"], opened(row["archive"])
                        content = _member_bytes(file, row)
                    except Exception as problem:  # any damage leaves the others readable
                        error = str(problem) or type(problem).__name__
                yield row["archive"], row["member_index"], row["member"], content, error
        finally:
            if file is not None:
                file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batched(rows(batch))

    return members.mapInArrow(run, ARCHIVE_MEMBERS)


def expand_archive_files(
    files: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, tasks: int | None = None
) -> DataFrame:
    """The members of archive files of any size: ``expand_archives`` without their contents.

    ``files``: ``path, length``. One stage lists the members, a second reads them, a member a
    row, spread by archive and member over ``tasks``; without a number, over one task for
    each ``_TASK_BYTES`` of archives. Neither an archive nor its directory is a value.
    """
    if tasks is None:
        total = files.agg(F.sum("length")).first()[0] or 0
        tasks = min(_MOST_TASKS, int(total) // _TASK_BYTES + 1)
        tasks = max(tasks, files.sparkSession.sparkContext.defaultParallelism)
    listed = list_members(files, extensions)
    return read_members(
        listed.repartition(tasks, "archive", "member_index").sortWithinPartitions(
            "archive", "member_index"
        )
    )
