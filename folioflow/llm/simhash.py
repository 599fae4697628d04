"""Near-duplicate texts by 64-bit fingerprints, compared in bit-sliced blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, per_batch, texts_as_bytes, written
from .graph import components, forest

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
# Fingerprints of one bucket that a task compares at once; larger buckets are cut in chunks.
CHUNK = 1024
# Expected fingerprints in a bucket beyond which a finer cut of the bits is taken.
BUCKET_ROWS = 256
# Large buckets up to which they are broadcast, about 40 bytes each; more are joined by shuffle.
BROADCAST_BUCKETS = 1 << 18
# Rows a task gathers before it compares them.
LANES = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Byte to eight byte-wide counters, one per bit.
_SPREAD = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).view(np.uint64)[:, 0]


def shingle_hashes(text: bytes | None, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; a shorter text is one run."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list: bits set in over half of its hashes; none gives zero."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    result = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    flat = np.fromiter(
        itertools.chain.from_iterable(hashes), dtype=np.uint64, count=int(sizes.sum())
    )
    starts = np.concatenate([[0], np.cumsum(sizes[full])])
    # Byte-wide counters hold 255 at most, so long texts are summed in stretches.
    cuts = [np.arange(a, b, 255) for a, b in zip(starts[:-1], starts[1:])]
    firsts = np.cumsum([0, *(len(c) for c in cuts[:-1])])
    lanes = _SPREAD[flat.view(np.uint8).reshape(-1, 8)]
    partial = np.add.reduceat(lanes, np.concatenate(cuts), axis=0).view(np.uint8)
    counts = np.add.reduceat(partial.astype(np.uint32), firsts, axis=0)
    bits = (2 * counts.astype(np.int64) > sizes[full][:, None]).astype(np.uint8)
    result[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return result


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, fingerprint`` (a signed long holding the 64 bits) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t) for t in texts_as_bytes(batch.column(1))]
        values = majority_bits(hashes).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values)], names=["id", "fingerprint"]
        )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch(run), f"id {kind}, fingerprint BIGINT")


def piece_masks(radius: int, pieces: int) -> list[int]:
    """Masks of ``pieces - radius`` of the pieces: bits within the radius agree on one of them."""
    edges = [BITS * i // pieces for i in range(pieces + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(masks, pieces - radius)]


def masks_for(count: int, radius: int) -> list[int]:
    """The coarsest cut whose buckets are expected to hold ``BUCKET_ROWS`` rows at most.

    Every cut finds every pair; a finer one trades more tables for smaller buckets.
    """
    for pieces in range(radius + 1, radius + 5):
        masks = piece_masks(radius, pieces)
        if count >> min(m.bit_count() for m in masks) <= BUCKET_ROWS:
            break
    return masks


class BitPlanes:
    """Fingerprints stored vertically: word ``w`` of plane ``b`` has bit ``b`` of 64 of them."""

    def __init__(self, values: np.ndarray):
        lanes = -len(values) % 64
        padded = np.concatenate([values, np.zeros(lanes + 64, dtype=np.uint64)])
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = self.packed(bits.T)

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.ascontiguousarray(bits), axis=-1, bitorder="little").view(np.uint64)


def _ahead(plane: np.ndarray, words: np.ndarray, shift: int) -> np.ndarray:
    """The lanes ``shift`` places further on."""
    step, rest = divmod(shift, 64)
    last = len(plane) - 1
    here = plane[np.minimum(words + step, last)]
    if not rest:
        return here
    onward = plane[np.minimum(words + step + 1, last)]
    return (here >> np.uint64(rest)) | (onward << np.uint64(64 - rest))


def close_pairs(
    values: np.ndarray, group: np.ndarray, side: np.ndarray, order: list[int], radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one group that differ in ``radius`` bits at most.

    Groups are contiguous. ``side`` is 0 or 1 in groups whose two sides are compared with each
    other only, and 2 where all are. For each shift, all lanes are compared with those so many
    places on: differing bits of 64 pairs are one word, and counters in carry-save form, one
    word per binary digit, add up two planes at a time. They start so that they overflow as
    the radius is passed. Words whose pairs all have passed it are dropped between planes.
    """
    size = len(values)
    if size < 2:
        return
    planes = BitPlanes(values).planes
    width = planes.shape[1]
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, size)
    reach = np.zeros(width * 64, dtype=np.int64)
    reach[:size] = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(size)
    lanes = reach.reshape(width, 64)
    furthest = lanes.max(axis=1)
    flags = np.zeros((2, width * 64), dtype=np.uint8)
    flags[0, :size], flags[1, :size] = side == 1, side == 2
    second, free = BitPlanes.packed(flags)
    digits = max(1, radius.bit_length())
    spare = (1 << digits) - 1 - radius
    everything = ~np.uint64(0)
    active = np.arange(width)
    shift = 0
    while True:
        shift += 1
        active = active[furthest[active] > shift]
        if not len(active):
            return
        alive = BitPlanes.packed((lanes[active] > shift).view(np.uint8)).reshape(-1)
        alive &= free[active] | (second[active] ^ _ahead(second, active, shift))
        kept = np.flatnonzero(alive)
        words, alive = active[kept], alive[kept]
        counters = [
            np.full(len(words), everything if spare >> d & 1 else np.uint64(0)) for d in range(digits)
        ]
        for done in range(0, len(order), 2):
            if not len(words):
                break
            carry = None
            if done + 1 < len(order):
                first, other = (
                    planes[b][words] ^ _ahead(planes[b], words, shift)
                    for b in order[done : done + 2]
                )
                half = counters[0] ^ first
                carry = (counters[0] & first) | (half & other)
                counters[0] = half ^ other
            else:
                first = planes[order[done]][words] ^ _ahead(planes[order[done]], words, shift)
                carry = counters[0] & first
                counters[0] = counters[0] ^ first
            for d in range(1, digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            alive &= ~carry
            if done % 8 == 6:
                kept = np.flatnonzero(alive)
                if 4 * len(kept) <= 3 * len(words):
                    words, alive = words[kept], alive[kept]
                    counters = [c[kept] for c in counters]
        kept = np.flatnonzero(alive)
        if len(kept):
            bits = np.unpackbits(
                alive[kept].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            )
            row, lane = np.nonzero(bits)
            at = words[kept][row] * 64 + lane
            yield at, at + shift


def _links(masks: list[int], radius: int):
    """Star edges between close fingerprints of each bucket, over rows sorted by bucket."""

    def compare(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = ("table", "bucket", "first", "second")
        change = np.zeros(len(rows["table"]), dtype=bool)
        for k in keys:
            change[1:] |= rows[k][1:] != rows[k][:-1]
        group = np.cumsum(change)
        for table in np.unique(rows["table"]):
            mask = masks[table]
            here = np.flatnonzero(rows["table"] == table)
            values = rows["fingerprint"][here]
            # Bits of the bucket's key agree anyway.
            order = [b for b in range(BITS) if not mask >> b & 1]
            held: list[np.ndarray] = [np.empty((2, 0), dtype=np.int64)]
            count = 0
            for left, right in close_pairs(
                values.view(np.uint64), group[here], rows["side"][here], order, radius
            ):
                held.append(np.stack([left, right]))
                count += len(left)
                if count > 1 << 20:
                    label = forest(len(values), *np.concatenate(held, axis=1))
                    held = [np.stack([np.arange(len(values)), label])]
                    count = 0
            label = forest(len(values), *np.concatenate(held, axis=1))
            moved = np.flatnonzero(label != np.arange(len(values)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[moved]), pa.array(values[label[moved]])], names=["a", "b"]
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            fresh = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            held = (
                fresh
                if held is None
                else {n: np.concatenate([held[n], fresh[n]]) for n in fresh}
            )
            size = len(held["table"])
            if size < LANES:
                continue
            last = {k: held[k][-1] for k in ("table", "bucket", "first", "second")}
            open_from = size - 1
            same = np.ones(size, dtype=bool)
            for k, v in last.items():
                same &= held[k] == v
            open_from = int(np.argmax(same))
            yield from compare({n: v[:open_from] for n, v in held.items()})
            held = {n: v[open_from:] for n, v in held.items()}
        if held is not None:
            yield from compare(held)

    return run


def close_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` that span the links among distinct values of ``fingerprint``.

    Two values within the radius agree on a whole combination of bit pieces, so comparing
    within the buckets of each combination loses no link. Buckets of more than ``CHUNK``
    values are cut in chunks and every pair of chunks is a group of its own; what a group
    emits is a spanning forest, never its pairs.
    """
    distinct = distinct.select("fingerprint")
    masks = masks_for(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed])
    rows = distinct.select("fingerprint", F.posexplode(keys).alias("table", "bucket"))
    large = (
        rows.groupBy("table", "bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .filter(F.col("_size") > CHUNK)
        .select("table", "bucket", F.ceil(F.col("_size") / F.lit(CHUNK)).alias("_chunks"))
    )
    # Cut where the rows are read, so that no shuffle gathers a large bucket.
    large = broadcast_if_few(written(large, "simhash-large"), BROADCAST_BUCKETS)
    chunks = F.coalesce(F.col("_chunks"), F.lit(1))
    own = F.pmod(F.xxhash64("fingerprint"), chunks)
    # A third side, 2, marks groups in which all are compared with all.
    spread = (
        rows.join(large, ["table", "bucket"], "left")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "table",
            "bucket",
            F.least("_own", "_other").alias("first"),
            F.greatest("_own", "_other").alias("second"),
            F.when(F.col("_own") == F.col("_other"), 2)
            .otherwise((F.col("_own") > F.col("_other")).cast("int"))
            .alias("side"),
            "fingerprint",
        )
    )
    group = ["table", "bucket", "first", "second"]
    return (
        spread.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(_links(masks, radius), "a BIGINT, b BIGINT")
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    radius: int = RADIUS,
) -> DataFrame:
    """``id, fingerprint, component_id`` per row; the smallest id reachable over close texts.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one node of the graph, so a group of copies costs one comparison. A
    repeated row keeps its place in the result; a null id is never the name of a component
    that has another. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_column, text_column), "simhash-rows")
    groups = written(
        rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "simhash-groups"
    )
    linked = components(close_fingerprints(groups, radius)).withColumnRenamed(
        "node", "fingerprint"
    )
    smallest = (
        linked.join(groups, "fingerprint").groupBy("root").agg(F.min("first_id").alias("low"))
    )
    named = written(
        groups.join(linked.join(smallest, "root"), "fingerprint", "left").select(
            "fingerprint", F.coalesce("low", "first_id").alias("component_id")
        ),
        "simhash-components",
    )
    return rows.join(named, "fingerprint", "left").select("id", "fingerprint", "component_id")


def fingerprint_text(column: str = "fingerprint"):
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
