"""WARC archives written by Spark, and read back along verified chains of records."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Fixed values of the format.
MAGIC = b"WARC/1."
BREAK = "\r\n"
END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
# Bytes of an archive that one task searches at a time, and payload bytes it hands on at once.
BLOCK_BYTES = 1 << 24
BATCH_BYTES = 1 << 23
# Blocks get a task each up to so many tasks; their rows are too small to be counted by size.
MOST_TASKS = 10_000
# Repeated payloads up to which their table is broadcast; beyond, the rows are shuffled to it.
BROADCAST_ROWS = 200_000

_VERSION = re.compile(rb"WARC/\d\.\d$")
_FIELD = re.compile(rb"([^\x00-\x20:\x7f]+):[ \t]*(.*?)[ \t]*$", re.S)


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``record_id, target_uri, payload, refers_to`` as one archive per partition.

    ``payload`` is binary or a string; null is empty. A record with ``refers_to`` is a revisit
    without the payload, others are responses. Control characters are dropped from ids and
    URIs. The text writer puts the records down byte for byte, with its commit protocol, so a
    lost task leaves nothing behind.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    clean = {
        c: F.regexp_replace(F.col(c).cast("string"), "[\\x00-\\x20\\x7f]", "")
        for c in ("record_id", "target_uri", "refers_to")
    }
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length(payload)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"),
        F.lit("Content-Length: "),
        size.cast("string"),
        F.lit(END),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(payload)

    def field(name: str, value) -> list:
        return [F.lit(f"{name}: "), value, F.lit(BREAK)]

    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        *field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        *field("WARC-Record-ID", F.concat(F.lit("<"), clean["record_id"], F.lit(">"))),
        *field("WARC-Date", F.lit(DATE)),
        *field("WARC-Target-URI", F.coalesce(clean["target_uri"], F.lit(""))),
        *field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload))),
        F.when(
            revisit,
            F.concat(
                *field("WARC-Profile", F.lit(IDENTICAL)),
                *field("WARC-Refers-To", F.concat(F.lit("<"), clean["refers_to"], F.lit(">"))),
            ),
        ).otherwise(""),
        *field("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(END),
        http,
    )
    whole = F.concat(head.cast("binary"), body).cast("string").alias("value")
    records.select(whole).write.option("lineSep", END).text(path)


class Archive:
    """Ranges of one file, from a block held in memory where possible."""

    def __init__(self, path: str, length: int):
        system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        self.file, self.length = system.open_input_file(inner), length
        self.begin, self.held = 0, b""

    def hold(self, begin: int, size: int) -> bytes:
        self.begin, self.held = begin, self.file.read_at(min(size, self.length - begin), begin)
        return self.held

    def bytes_at(self, begin: int, size: int) -> bytes:
        at = begin - self.begin
        if 0 <= at and at + size <= len(self.held):
            return self.held[at : at + size]
        return self.file.read_at(max(0, min(size, self.length - begin)), begin)

    def record(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Header fields, start and size of the block of the record at ``at``, if there is one."""
        size = 1 << 11
        while True:
            data = self.bytes_at(at, size)
            end = data.find(b"\r\n\r\n")
            lines = (data if end < 0 else data[:end]).split(b"\r\n")
            if end < 0:
                lines.pop()
            if lines and not _VERSION.match(lines[0]):
                return None
            fields = {}
            for line in lines[1:]:
                found = _FIELD.match(line)
                if not found:
                    return None
                fields[found[1].decode(errors="replace").lower()] = found[2].decode(
                    errors="replace"
                )
            if end >= 0:
                break
            if at + size >= self.length:
                return None
            size *= 2
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return None
        return fields, at + end + 4, int(length)

    def successor(self, at: int) -> int | None:
        """Where the record after the one at ``at`` begins, if that one is whole."""
        found = self.record(at)
        if found is None:
            return None
        stop = found[1] + found[2]
        return stop + 4 if self.bytes_at(stop, 4) == b"\r\n\r\n" else None


def archive_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, length, begin, stop`` of blocks of every file; contents are not read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    blocks = F.ceil(F.col("length") / F.lit(block_bytes))
    tasks = min(MOST_TASKS, files.agg(F.sum(blocks)).first()[0] or 1)
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes)))
    return (
        files.select("path", "length")
        .filter("length > 0")
        .select("path", "length", begin.alias("begin"))
        .withColumn("stop", F.least(F.col("begin") + block_bytes, "length"))
        .repartition(tasks, "path", "begin")
    )


def _chains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each block, with the place where the chain from each leaves the block.

    Candidates are taken from the last to the first, so each follows its successor's way.
    """
    for batch in batches:
        for path, length, begin, stop in zip(*(c.to_pylist() for c in batch.columns)):
            archive = Archive(path, length)
            data = archive.hold(begin, stop - begin + len(MAGIC) - 1)
            places, at = [], data.find(MAGIC)
            while at >= 0:
                places.append(begin + at)
                at = data.find(MAGIC, at + 1)
            leaves: dict[int, int] = {}
            for place in reversed(places):
                after = archive.successor(place)
                if after is not None:
                    after = after if after >= stop else leaves.get(after)
                if after is not None:
                    leaves[place] = after
                else:
                    leaves[place] = -1  # the chain breaks here
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * len(leaves), pa.string()),
                    pa.array(list(leaves), pa.int64()),
                    pa.array(list(leaves.values()), pa.int64()),
                ],
                names=["path", "at", "to"],
            )


def reachable(jumps: DataFrame) -> DataFrame:
    """``path, at`` of the places that the chain from the start of each file comes to.

    Only starts and places where some chain enters a block take part. Pointers double in
    length each round, so rounds grow with the logarithm of a file's number of blocks; every
    round is a join on path and place over a table in the shared folder.
    """
    entered = jumps.select("path", F.col("to").alias("at")).distinct()
    hops = written(
        jumps.join(entered, ["path", "at"], "left_semi")
        .union(jumps.filter("at = 0"))
        .distinct(),
        "warc-hops",
    )
    found = written(hops.filter("at = 0").select("path", "at"), "warc-reached")
    count = found.count()
    while True:
        onward = found.join(hops, ["path", "at"]).select("path", F.col("to").alias("at"))
        more = written(
            found.union(onward.filter("at >= 0")).distinct(),
            "warc-reached",
        )
        grown = more.count()
        if grown == count:
            return found
        found, count = more, grown
        second = hops.select("path", F.col("at").alias("to"), F.col("to").alias("_then"))
        hops = written(
            hops.join(second, ["path", "to"]).select("path", "at", F.col("_then").alias("to")),
            "warc-hops",
        )


RECORD = (
    "path STRING, offset BIGINT, record_id STRING, record_type STRING, target_uri STRING,"
    " refers_to STRING, declared_digest STRING, payload_bytes BIGINT, payload BINARY"
)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def bare(value: str | None) -> str | None:
        return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value

    rows, held = [], 0
    for batch in batches:
        for path, length, at, stop in zip(*(c.to_pylist() for c in batch.columns)):
            archive = Archive(path, length)
            archive.hold(at, stop - at)
            while at < stop and (found := archive.record(at)):
                fields, begin, size = found
                block = archive.bytes_at(begin, size)
                payload, declared = block, size
                if fields.get("content-type", "").startswith("application/http"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    sizes = re.findall(rb"(?im)^content-length:[ \t]*(\d+)\r?$", head)
                    declared = int(sizes[-1]) if sizes else len(payload)
                kind = fields.get("warc-type")
                rows.append(
                    (
                        path,
                        at,
                        bare(fields.get("warc-record-id")),
                        kind,
                        fields.get("warc-target-uri"),
                        bare(fields.get("warc-refers-to")),
                        fields.get("warc-payload-digest", "").partition(":")[2].lower() or None,
                        declared if kind == "revisit" else len(payload),
                        None if kind == "revisit" else payload,
                    )
                )
                held += len(payload)
                if held > BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
                at = begin + size + 4
    if rows:
        yield packed(rows)


def read_archives(
    spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The records of uncompressed archives under ``path``, in the columns of ``RECORD``.

    Tasks search blocks of every file for what looks like a record and emit where it leads;
    what the chain from the file's start does not reach, such as records inside payloads, is
    no record. Reading stops for good where a chain breaks: see ``broken_chains``. A payload
    is one value of one row; files may be of any size. ``payload`` is null for revisits, whose
    ``payload_bytes`` is what the stored HTTP head declares. Empty files hold no records, and
    a folder without records gives no rows. Records that are there twice are both returned.
    """
    blocks = archive_blocks(spark, path, block_bytes)
    jumps = written(blocks.mapInArrow(_chains, "path STRING, at BIGINT, to BIGINT"), "warc-jumps")
    entries = reachable(jumps).withColumn(
        "begin", F.col("at") - F.pmod(F.col("at"), F.lit(block_bytes))
    )
    walks = entries.join(blocks, ["path", "begin"]).select("path", "length", "at", "stop")
    tasks = max(1, min(MOST_TASKS, entries.count()))
    return walks.repartition(tasks, "path", "at").mapInArrow(_records, RECORD)


def broken_chains(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, read_bytes, length`` of files whose chain of records ends before the file does."""
    ends = read_archives(spark, path, block_bytes).groupBy("path").agg(F.max("offset").alias("at"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, length, at in zip(*(c.to_pylist() for c in batch.columns)):
                stop = 0 if at is None else Archive(file, length).successor(at) or at
                if stop < length:
                    rows.append((file, stop, length))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in rows], k)
                    for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))
                ],
                names=["path", "read_bytes", "length"],
            )

    files = archive_blocks(spark, path, block_bytes).filter("begin = 0").select("path", "length")
    return files.join(ends, "path", "left").mapInArrow(
        measure, "path STRING, read_bytes BIGINT, length BIGINT"
    )


def revisit_roles(
    rows: DataFrame, id_column: str, min_bytes: int = 1000
) -> DataFrame:
    """``rows`` (with binary ``payload``) and ``refers_to``: the id that holds the same payload.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest id keeps it and
    the others refer to it; every other row has null. Rows that repeat the largest id all keep
    it, and rows without an id refer to it. Only payloads that occur twice take part in the
    join, one row each, with counts combined before the shuffle. Few of them are broadcast, so
    that the payloads stay where they are read; with many, the rows are shuffled.
    """
    sized = rows.withColumn("_digest", F.sha1("payload")).withColumn(
        "_bytes", F.octet_length("payload")
    )
    keepers = (
        sized.filter(F.col("_bytes") >= min_bytes)
        .groupBy("_digest", "_bytes")
        .agg(F.max(id_column).alias("_keeper"), F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1 AND _keeper IS NOT NULL")
        .drop("_rows")
    )
    keepers = written(keepers, "warc-keepers")
    if keepers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keepers = F.broadcast(keepers)
    # The extra key lets adaptive execution split a payload that many rows share.
    keys = ["_digest", "_bytes"]
    spread = F.xxhash64(*keys)
    joined = sized.withColumn("_spread", spread).join(
        keepers.withColumn("_spread", spread), [*keys, "_spread"], "left"
    )
    refers = F.when(~F.col(id_column).eqNullSafe(F.col("_keeper")), F.col("_keeper"))
    return joined.withColumn("refers_to", refers).drop(*keys, "_spread", "_keeper")
