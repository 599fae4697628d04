"""The newest requests of each path, kept as state of a stream."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.operators.reports import latency_metrics_by
from folioflow.operators.sampling import HISTORY_SIZE, newest

from .upserts import current_rows, upsert

# Rings that a path's requests are spread over, so that a busy path is no single state.
SALTS = 8


def newest_rings(
    requests: DataFrame,
    order: Sequence[str] = ("ts",),
    by: str = "path",
    size: int = HISTORY_SIZE,
    idle: str | None = None,
    late_by: str = "0 seconds",
    salts: int = SALTS,
) -> DataFrame:
    """The rings that a micro-batch changes: ``by, ring, place``, ``order`` and ``elapsed_ms``.

    Each path has ``salts`` rings of the newest ``size`` requests by ``order`` (the time
    column, then tie-breakers); a request goes to a ring by a hash of its order, so the newest
    ``size`` of the path are the newest of its rings together, exactly. A ring is a keyed state
    of bounded size. Its rows are given whole whenever it changes, ``place`` counting from
    0 for the newest. With ``idle`` (such as ``"1 day"``) a ring whose newest request lies so
    far behind the watermark, ``late_by`` behind the newest time seen, is dropped; its last
    row has the place -1 and nulls. Requests without a time are left out.
    """
    columns = [*order, "elapsed_ms"]
    time = order[0]
    rows = requests.filter(F.col(time).isNotNull()).select(
        by, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int").alias("ring"), *columns
    )
    if idle is not None:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late_by)
    fields = [rows.schema[by], rows.schema["ring"], T.StructField("place", T.IntegerType())]
    output = T.StructType([*fields, *(rows.schema[c] for c in columns)])
    keep_for = None if idle is None else pd.Timedelta(idle)

    def emptied(key: tuple) -> pd.DataFrame:
        row = {by: [key[0]], "ring": [key[1]], "place": [-1]}
        return pd.DataFrame({**row, **{c: [None] for c in columns}}, dtype="object")

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield emptied(key)
            return
        ring = pd.read_parquet(io.BytesIO(state.get[0])) if state.exists else None
        for frame in frames:
            fresh = frame[columns]
            ring = fresh if ring is None else pd.concat([ring, fresh], ignore_index=True)
            ring = ring.sort_values(list(order), ascending=False, kind="stable").head(size)
        stored = io.BytesIO()
        ring.to_parquet(stored, index=False)
        state.update((stored.getvalue(),))
        if keep_for is not None:
            last = int((ring[time].iloc[0] + keep_for).timestamp() * 1000)
            # A ring that is overdue already goes as soon as it may.
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        result = ring.reset_index(drop=True)
        result.insert(0, "place", range(len(result)))
        result.insert(0, "ring", key[1])
        result.insert(0, by, key[0])
        yield result

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(by, "ring").applyInPandasWithState(
        step, output, "requests BINARY", "update", timeout
    )


def keep_rings(
    rings: DataFrame,
    root: str,
    checkpoint: str,
    by: str = "path",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start keeping the rings of a stream under ``root``."""
    return (
        rings.writeStream.foreachBatch(
            lambda batch, batch_id: upsert(batch, batch_id, root, (by, "ring"))
        )
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ring_history(
    spark: SparkSession,
    root: str,
    rings: DataFrame,
    order: Sequence[str] = ("ts",),
    by: str = "path",
    size: int = HISTORY_SIZE,
) -> DataFrame:
    """The newest ``size`` requests of each path, from its rings as last written."""
    rows = current_rows(spark, root, rings.schema).filter("place >= 0")
    return newest(rows.drop("ring", "place"), order, size, (by,))


def ring_metrics(
    spark: SparkSession,
    root: str,
    rings: DataFrame,
    order: Sequence[str] = ("ts",),
    by: str = "path",
    size: int = HISTORY_SIZE,
) -> DataFrame:
    """Snapshot of the latency metrics of each path."""
    return latency_metrics_by(ring_history(spark, root, rings, order, by, size), (by,))
