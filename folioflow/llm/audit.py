"""How filters of documents interact: what each removes alone, first, or after others."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, per_batch, quoted, texts_as_bytes, written

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
FORBIDDEN = b"#$%&*|"
# The filters in the order of their bits; the last is found by joins, the others in a text.
FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")

# Rows of one hash that a task takes in the join of copies.
SALT_ROWS = 2048
# Repeated hashes up to which they are broadcast, 16 bytes each; more are joined by shuffle.
BROADCAST_HASHES = 1 << 20

_UPPER = bytes(range(65, 91))
_TRAILING = bytes(range(0x80, 0xC0))


def text_failures(text: bytes | None) -> int:
    """Bits of the filters that a text fails by itself; null is an empty text.

    A: under 200 words. B: under half of the words are distinct. C: over 3 % of the code
    points are capitals A to Z. D: one of ``#$%&*|`` occurs.
    """
    text = text or b""
    words = text.split()
    points = len(text.translate(None, _TRAILING))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_UPPER_PERCENT * points) << 2
        | (len(text.translate(None, FORBIDDEN)) < len(text)) << 3
    )


def _failures(batch: pa.RecordBatch) -> pa.RecordBatch:
    bits = np.array([text_failures(t) for t in texts_as_bytes(batch.column(1))], dtype=np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["_row", "bits"])


def earlier_copies(
    docs: DataFrame,
    hashes: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_hashes: int = BROADCAST_HASHES,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """``id, hash`` and all other columns but the text, of rows with an earlier copy.

    A row has one if a smaller id has exactly its text, null being an empty text; rows of one
    id are not earlier than each other, and a null id is neither earlier nor later. Repeated
    rows are all returned.

    ``hashes`` (``id, hash`` per row, ``hash`` being XXH64 of the text) tells which hashes
    have more than one id; only texts of those are shuffled. Copies are cut down to one
    text with its smallest id before they meet the rows, and rows of a frequent hash are
    spread over as many salts as they need, so neither side grows with the square of a group.
    """
    repeated = (
        hashes.filter("id IS NOT NULL")
        .groupBy("hash")
        .agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count(F.lit(1)).alias("_n"))
        .filter("_low < _high")
        .select(
            F.col("hash").alias("_hash"),
            F.ceil(F.col("_n") / F.lit(salt_rows)).cast("int").alias("_salts"),
        )
    )
    repeated = broadcast_if_few(written(repeated, "audit-repeated"), broadcast_hashes)
    carried = [c for c in docs.columns if c not in (id_column, text_column)]
    text = F.coalesce(F.col(quoted(text_column)), F.lit(""))
    rows = docs.select(
        F.col(quoted(id_column)).alias("id"),
        text.alias("_text"),
        F.xxhash64(text).alias("hash"),
        *(F.col(quoted(c)) for c in carried),
    ).filter("id IS NOT NULL")
    candidates = rows.join(repeated, rows["hash"] == repeated["_hash"]).drop("_hash")
    salt = F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")
    firsts = (
        candidates.groupBy("hash", "_text")
        .agg(F.min("id").alias("_first"), F.max("_salts").alias("_salts"))
        .select(
            F.col("hash").alias("_hash"),
            F.col("_text").alias("_same"),
            "_first",
            F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_part"),
        )
    )
    left = candidates.withColumn("_salt", salt).drop("_salts")
    return left.join(
        firsts,
        (F.col("hash") == F.col("_hash"))
        & (F.col("_salt") == F.col("_part"))
        & (F.col("_text") == F.col("_same"))
        & (F.col("_first") < F.col("id")),
        "left_semi",
    ).drop("_text", "_salt")


def failure_bits(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "lang",
) -> DataFrame:
    """``id, part, bits, n``: documents by the filters that they fail, ``n`` rows of each.

    The failures found in texts and those found by the join of copies are put under each other
    and combined by id, text hash and part, so that rows sharing an id stay apart unless their
    texts and parts are equal too. A null part is an empty string.
    """
    text, part = F.col(quoted(text_column)), F.col(quoted(part_column)).cast("string")
    part = F.coalesce(part, F.lit(""))
    rows = docs.select(
        F.struct(
            F.col(quoted(id_column)).alias("id"),
            part.alias("part"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        ).alias("_row"),
        text.alias("_text"),
    )
    kind = rows.schema["_row"].dataType.simpleString()
    alone = written(
        rows.mapInArrow(per_batch(_failures), f"_row {kind}, bits INT").select("_row.*", "bits"),
        "audit-failures",
    )
    named = docs.select(
        F.col(quoted(id_column)).alias("id"), text.alias("_whole"), part.alias("part")
    )
    copies = earlier_copies(named, alone.select("id", "hash"), "id", "_whole")
    together = alone.select("id", "part", "hash", "bits", F.lit(1).alias("rows")).unionByName(
        copies.select("id", "part", "hash", F.lit(COPY_BIT).alias("bits"), F.lit(0).alias("rows"))
    )
    return (
        together.groupBy("id", "part", "hash")
        .agg(F.bit_or("bits").alias("bits"), F.sum("rows").alias("n"))
        .groupBy("id", "part", "bits")
        .agg(F.sum("n").alias("n"))
    )


def order_steps(filters: Sequence[str] = FILTERS) -> Iterator[tuple[str, int, int, int]]:
    """Of every order: its name, the step, bits of the filters before, and bit of the step's."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    for order in itertools.permutations(filters):
        for step, f in enumerate(order):
            yield "".join(order), step + 1, sum(bit[b] for b in order[:step]), bit[f]


def interaction_audit(
    failures: DataFrame, labels: DataFrame, filters: Sequence[str] = FILTERS
) -> DataFrame:
    """What each filter removes at each step of every order, per part, zeros included.

    ``failures`` is ``id, part, bits, n``; ``labels`` is ``id, good, toxic`` with one row per
    id. Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``. Documents without a label count as neither good nor toxic.
    ``shapley`` is what the filter removes, summed over all orders: a document that fails k
    filters is removed by each of them in one k-th of the orders. An empty table has no parts
    and gives no rows.

    Documents are counted by part and combination first, so all that meets the orders is one
    row per part with 2^filters counts at most.
    """
    counted = (
        failures.join(labels, "id", "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )
    parts = counted.groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("_found")
    )
    steps = [
        F.struct(
            F.lit(order).alias("filter_order"),
            F.lit(step).alias("step"),
            F.lit(before).alias("_before"),
            F.lit(bit).alias("_bit"),
        )
        for order, step, before, bit in order_steps(filters)
    ]
    rows = parts.select("part", "_found", F.explode(F.array(*steps)).alias("_step")).select(
        "part", "_found", "_step.*"
    )
    orders = math.factorial(len(filters))

    def counts(kind: str, c: Column) -> Column:
        before = c["bits"].bitwiseAND(F.col("_before")) != 0
        fails = c["bits"].bitwiseAND(F.col("_bit")) != 0
        return {
            "kept": ~before & ~fails,
            "removed": ~before & fails,
            "redundant": before & fails,
            "fails": fails,
            "unique": c["bits"] == F.col("_bit"),
        }[kind]

    def total(kind: str, value=lambda c: c["n"]) -> Column:
        some = F.filter("_found", lambda c: counts(kind, c))
        return F.aggregate(some, F.lit(0).cast("bigint"), lambda a, c: a + value(c))

    def share(c: Column) -> Column:
        return (F.lit(orders) / F.bit_count(c["bits"])).cast("bigint")

    return rows.select(
        "part",
        "filter_order",
        "step",
        total("kept").alias("kept"),
        total("removed").alias("removed"),
        total("redundant").alias("redundant"),
        total("unique").alias("unique_fails"),
        total("removed", lambda c: c["good"]).alias("good_lost"),
        total("removed", lambda c: c["toxic"]).alias("toxic_lost"),
        total("fails", lambda c: c["n"] * share(c)).alias("shapley"),
    )


def document_labels(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id, good, toxic``: whether any label of a document says so; null ids are left out."""
    return (
        labels.filter(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
