"""Near-duplicate vectors: sign hashing in several tables, exact cosines, components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, extended, per_batch, worker_cache, written
from .graph import components, forest

THRESHOLD = 0.93
# Share of the pairs just at the threshold that at least one table must bring together.
RECALL = 0.999
# Distinct vectors of a label expected in a bucket, and bounds of the bits in a table's code.
BUCKET_ROWS = 128
FEWEST_BITS, MOST_BITS = 6, 16
# Rows of one bucket compared at once; larger buckets are cut in chunks.
CHUNK = 1024
# Large buckets up to which they are broadcast, about 60 bytes each; more are joined by shuffle.
BROADCAST_BUCKETS = 1 << 18
SEED = 7


def table_count(bits: int, threshold: float, recall: float) -> int:
    """Tables needed so that vectors at the threshold share a code with the given chance."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def unit_rows(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    rows = flat.astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(), lengths


def sign_codes(classes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``classes`` with the signs of projections on random directions, a code per table.

    ``places`` has the codes as numbers, ``codes`` the same as little-endian 16-bit numbers.
    """
    carried = classes.columns
    at = carried.index("vector")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, lengths = _vectors(batch.column(at))
        starts = np.cumsum(lengths) - lengths
        codes = np.zeros((batch.num_rows, tables), dtype=np.int64)
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            values = unit_rows(flat[(starts[rows][:, None] + np.arange(size)).reshape(-1)], size)
            directions = worker_cache(
                f"directions_{seed}_{bits}_{tables}_{size}",
                lambda: np.random.default_rng([seed, size]).standard_normal((size, tables * bits)),
            )
            signs = (values @ directions > 0).reshape(len(rows), tables, bits)
            codes[rows] = signs @ (1 << np.arange(bits))
        offsets = np.arange(0, codes.size + 1, tables, dtype=np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(codes.reshape(-1).astype(np.int32))
        )
        short = pa.array([row.tobytes() for row in codes.astype("<u2")], pa.binary())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, lists, short], names=[*carried, "places", "codes"]
        )

    return classes.mapInArrow(
        per_batch(run), extended(classes.schema, "places ARRAY<INT>, codes BINARY")
    )


def _linked(rows: dict, threshold: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Per group of rows: weight of the links of each vector, and the first it hangs with.

    A pair counts in the first table that brings it together only.
    """
    flat, lengths = _vectors(rows["vector"])
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<u2").reshape(-1, tables)
    group, side, table = rows["group"], rows["side"], rows["table"]
    weight, ids = rows["weight"], rows["id"]
    edges = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    begun, ids_out, links_out, roots_out = 0, [], [], []
    for stop in edges:
        size = int(lengths[begun])
        if stop - begun > 1:
            values = unit_rows(flat[starts[begun] : starts[begun] + size * (stop - begun)], size)
            near = values @ values.T >= threshold
            here = side[begun:stop]
            if here[0] != 2:
                near &= here[:, None] != here[None, :]
            left, right = np.nonzero(np.triu(near, 1))
            if len(left):
                some = codes[begun:stop, : table[begun]]
                fresh = np.ones(len(left), dtype=bool)
                for column in some.T:
                    fresh &= column[left] != column[right]
                left, right = left[fresh], right[fresh]
            if len(left):
                count = stop - begun
                links = np.bincount(left, weight[begun:stop][right], count)
                links += np.bincount(right, weight[begun:stop][left], count)
                label = forest(count, left, right)
                found = np.flatnonzero(links)
                ids_out.append(ids[begun:stop][found])
                links_out.append(links[found].astype(np.int64))
                roots_out.append(ids[begun:stop][label[found]])
        begun = stop
    if ids_out:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(ids_out), pa.binary()),
                pa.array(np.concatenate(links_out)),
                pa.array(np.concatenate(roots_out), pa.binary()),
            ],
            names=["id", "links", "root"],
        )


def _compare(threshold: float, tables: int):
    keys = ("label", "size", "table", "code", "first", "second")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def numbered(table: pa.Table) -> np.ndarray:
            change = np.zeros(table.num_rows, dtype=bool)
            for k in keys:
                column = table[k].combine_chunks()
                codes = column.dictionary_encode().indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            return np.cumsum(change)

        def rows(table: pa.Table, group: np.ndarray) -> dict:
            return {
                "vector": table["vector"].combine_chunks(),
                "codes": table["codes"].combine_chunks(),
                "id": table["id"].to_numpy(),
                "weight": table["weight"].to_numpy(),
                "side": table["side"].to_numpy(),
                "table": table["table"].to_numpy(),
                "group": group,
            }

        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows < 8 * CHUNK:
                continue
            group = numbered(held)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                done = held.slice(0, cut)
                yield from _linked(rows(done, group[:cut]), threshold, tables)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _linked(rows(held, numbered(held)), threshold, tables)

    return run


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``id, n_links, component_id, kept`` per row: links by cosine among equal labels.

    Vectors of different lengths do not link. Null, empty and zero vectors, vectors with null
    or non-finite components, and rows without a label have no links and are components of
    their own. Equal vectors of a label are one node with a weight, so copies cost nothing;
    buckets beyond ``CHUNK`` nodes are compared chunk against chunk. Repeated rows count as
    vectors of their own, and so do rows that share an id, whatever their vectors and labels:
    nodes are told apart by a digest of both. A null id links like others, but names no
    component; one of null ids alone has the name null. Other columns are not read; an empty
    table gives no rows.
    """
    # The digest of the printed components stands for the vector.
    whole = F.concat_ws(",", F.transform("vector", lambda x: x.cast("string")))
    sound = (
        F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall(
            "vector", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False))
        )
        & F.exists("vector", lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(id_column).alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).alias("vector"),
    ).withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.md5(whole)))
    classes = written(
        rows.filter("key IS NOT NULL")
        .groupBy("label", "key")
        .agg(
            F.min("id").alias("first_id"),
            F.count(F.lit(1)).alias("weight"),
            F.any_value("vector").alias("vector"),
        )
        .withColumn("size", F.size("vector"))
        .withColumn("id", F.unhex(F.md5(F.concat_ws(" ", "key", F.col("label").cast("string"))))),
        "vector-classes",
    )
    largest = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 1
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(largest / BUCKET_ROWS))))
    tables = table_count(bits, threshold, recall)
    nodes = classes.drop("first_id", "key")
    # The codes of all tables travel along, in as few bytes as they take.
    coded = written(sign_codes(nodes, bits, tables), "vector-codes")

    bucket = ["label", "size", "table", "code"]
    rows_of = coded.select("*", F.posexplode("places").alias("table", "code")).drop("places")
    large = (
        rows_of.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > CHUNK)
        .withColumn("_chunks", F.ceil(F.col("_rows") / F.lit(CHUNK)))
        .drop("_rows")
    )
    # Cut where the rows are read, so that no shuffle gathers a large bucket.
    large = broadcast_if_few(written(large, "vector-large"), BROADCAST_BUCKETS)
    chunks = F.coalesce(F.col("_chunks"), F.lit(1))
    spread = (
        rows_of.join(large, bucket, "left")
        .withColumn("_own", F.pmod(F.xxhash64("id"), chunks))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        .withColumns(
            {
                "first": F.least("_own", "_other"),
                "second": F.greatest("_own", "_other"),
                "side": F.when(F.col("_own") == F.col("_other"), 2).otherwise(
                    (F.col("_own") > F.col("_other")).cast("int")
                ),
            }
        )
        .drop("_own", "_other", "_chunks")
    )
    group = [*bucket, "first", "second"]
    placed = spread.repartition(*group).sortWithinPartitions(*group)
    found = written(
        placed.mapInArrow(_compare(threshold, tables), "id BINARY, links BIGINT, root BINARY"),
        "vector-links",
    )
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found, "id", "root").withColumnRenamed("node", "id")
    firsts = classes.select("id", "first_id")
    lowest = reached.join(firsts, "id").groupBy("root").agg(F.min("first_id").alias("low"))
    named = reached.join(lowest, "root").select("id", "low", F.lit(True).alias("reached"))
    summary = written(
        classes.select("label", "key", "id", "weight", "first_id")
        .join(linked, "id", "left")
        .join(named, "id", "left")
        .select(
            "label",
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.when(F.col("reached"), F.col("low"))
            .otherwise(F.col("first_id"))
            .alias("component_id"),
        ),
        "vector-summary",
    )
    return (
        rows.select("id", "label", "key")
        .join(summary, ["label", "key"], "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.when(F.col("key").isNull(), F.col("id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
