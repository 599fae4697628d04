"""Newest-N history and uniform sampling of ordered items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.strings import as_column
from folioflow.session import scratch_path

from .joins import lookup_join, small_side

# History size, frames per medium, frames per medium in directory batches.
HISTORY_SIZE = 1000
MAX_FRAMES = 10
MAX_FRAMES_IN_BATCH = 5
# Parts that a group's rows are ranked in before the whole group is.
SALTS = 32
# Wanted rows up to which their places are broadcast, about 60 bytes each.
BROADCAST_ROWS = 100_000


def newest(
    df: DataFrame, order: Sequence[str], n: int = HISTORY_SIZE, by: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` rows last by ``order``, overall or per group.

    Overall it is a distributed top-n. Per group the best ``n`` of each of ``SALTS`` parts are
    found first, so that no task sorts a large group whole, whatever ``n`` is.
    """
    latest_first = [F.col(c).desc() for c in order]
    if not by:
        return df.orderBy(*latest_first).limit(n)
    rank = F.row_number()
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    first = parts.withColumn(
        "_rank", rank.over(Window.partitionBy(*by, "_part").orderBy(*latest_first))
    ).filter(F.col("_rank") <= n)
    return (
        first.withColumn("_rank", rank.over(Window.partitionBy(*by).orderBy(*latest_first)))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_part")
    )


def sampling_interval(total: Column, max_frames: int, frame_interval: int | None) -> Column:
    """The given step, or ``total // max_frames`` but at least 1."""
    if frame_interval is not None:
        return F.lit(frame_interval).cast("bigint")
    return F.greatest(F.lit(1), F.floor(total / F.lit(max_frames))).cast("bigint")


def sample_media(
    media: DataFrame,
    media_id: str = "media_id",
    total_frames: str = "total_frames",
    max_frames: int = MAX_FRAMES,
    frame_interval: int | None = None,
) -> DataFrame:
    """``media_id, sample_no, frame_idx, source_path`` from frame counts alone.

    Indices 0, i, 2i ... below the total, at most ``max_frames``; none for an empty medium.
    """
    total = as_column(total_frames).cast("bigint")
    step = sampling_interval(total, max_frames, frame_interval)
    taken = F.least(F.lit(max_frames).cast("bigint"), F.ceil(total / step)).cast("int")
    chosen = F.when((total > 0) & (taken > 0), F.sequence(F.lit(0), taken - 1))
    return media.select(
        media_id, step.alias("_step"), F.explode(chosen).alias("sample_no")
    ).select(
        media_id,
        "sample_no",
        (F.col("sample_no") * F.col("_step")).alias("frame_idx"),
        F.format_string("%s::frame_%d", as_column(media_id), F.col("sample_no")).alias(
            "source_path"
        ),
    )


def sample_positions(
    ranked: DataFrame,
    by: str,
    position: str,
    max_frames: int = MAX_FRAMES,
    frame_interval: int | None = None,
) -> DataFrame:
    """The same sampling over rows whose ``position`` counts 0, 1, 2 ... in every group.

    Group sizes are counted with map-side combining and joined back; no group is collected.
    Adds ``sample_no``.
    """
    totals = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("_total"))
    step = sampling_interval(F.col("_total"), max_frames, frame_interval)
    return (
        lookup_join(ranked, totals, [by], "inner")
        .withColumn("_step", step)
        .filter(
            (F.col(position) % F.col("_step") == 0)
            & (F.col(position) < F.col("_step") * F.lit(max_frames))
        )
        .withColumn("sample_no", F.expr(f"CAST({position} DIV _step AS INT)"))
        .drop("_total", "_step")
    )


def _numbered(by_at: int, carried: int):
    """Adds the partition and each row's number within its run of one group, rows in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        last, count = None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            column = batch.column(by_at)
            # A row opens a run where it differs from the one before, nulls being equal.
            here, before = column.slice(1), column.slice(0, size - 1)
            differs = pc.or_(
                pc.fill_null(pc.not_equal(here, before), False),
                pc.xor(pc.is_null(here), pc.is_null(before)),
            ).to_numpy(zero_copy_only=False)
            same_run = last is not None and column[0].as_py() == last[0]
            opens = np.append(not same_run, differs).astype(bool)
            places = np.arange(size)
            starts = np.maximum.accumulate(np.where(opens, places, -1))
            numbers = np.where(starts >= 0, places - starts, places + count)
            last, count = (column[size - 1].as_py(),), int(numbers[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:carried],
                    pa.array(np.full(size, partition, dtype=np.int32)),
                    pa.array(numbers.astype(np.int64)),
                ],
                names=[*batch.schema.names[:carried], "_part", "_number"],
            )

    return run


def numbered_in_order(df: DataFrame, by: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part, _number``, and ``by, _part, _start, _total`` of their runs.

    Rows are range-partitioned by group and order together, so a hot group spreads over many
    tasks, and each counts its rows in every range partition from 0; the result is stored
    once. ``_start`` is the position of a run's first row in its group: what the group has in
    the partitions before. The runs are far fewer than rows: one per group and partition.
    """
    ordered = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_number", T.LongType()),
        ]
    )
    numbered = ordered.mapInArrow(_numbered(df.columns.index(by), len(df.columns)), schema)
    path = scratch_path(df.sparkSession, "numbered")
    numbered.write.parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    runs = stored.groupBy(by, "_part").agg((F.max("_number") + 1).alias("_rows"))
    whole = Window.partitionBy(by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return stored, runs.select(
        by,
        "_part",
        "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(whole).alias("_total"),
    )


def sample_ordered(
    df: DataFrame,
    by: str,
    order: Sequence[str],
    max_frames: int = MAX_FRAMES,
    frame_interval: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Uniform sample of every ordered group, with ``position`` and ``sample_no``.

    Selection by rank: the wanted positions of a group follow from its size alone, and the
    sizes of its runs in the range partitions say in which partition and at which number each
    lies. Only those places meet the stored rows, broadcast where they are few, so after the
    sort no row is shuffled. ``order`` should be unique within a group for a repeatable
    result; nulls come first, and rows with a null group are a group.
    """
    stored, runs = numbered_in_order(df, by, order)
    step = sampling_interval(F.col("_total"), max_frames, frame_interval)
    # Of positions 0, i, 2i ... those that lie in the run.
    first = F.ceil(F.col("_start") / F.col("_step")).cast("bigint")
    last = F.least(
        F.lit(max_frames - 1).cast("bigint"),
        F.floor((F.col("_start") + F.col("_rows") - 1) / F.col("_step")).cast("bigint"),
    )
    chosen = F.when(first <= last, F.sequence(first, last))
    wanted = (
        runs.withColumn("_step", step)
        .select(F.col(by).alias("_by"), "_part", "_start", "_step", F.explode(chosen).alias("_no"))
        .select(
            "_by",
            F.col("_part").alias("_in"),
            (F.col("_no") * F.col("_step")).alias("position"),
            (F.col("_no") * F.col("_step") - F.col("_start")).alias("_at"),
            F.col("_no").cast("int").alias("sample_no"),
        )
    )
    path = scratch_path(df.sparkSession, "wanted")
    wanted.write.parquet(path)
    wanted = small_side(df.sparkSession.read.schema(wanted.schema).parquet(path), broadcast_rows)
    place = (
        F.col(by).eqNullSafe(F.col("_by"))
        & (F.col("_part") == F.col("_in"))
        & (F.col("_number") == F.col("_at"))
    )
    return stored.join(wanted, place).select(*df.columns, "position", "sample_no")
