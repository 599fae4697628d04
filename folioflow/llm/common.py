"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import scratch_path

HOLDER = "_folioflow_worker"
KEPT = 1


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` stored as a table in the shared folder and read back, cut from its lineage."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept in a Python worker over many tasks, made on first use.

    Functions are sent with the tasks by value, so their modules' globals start anew in each
    task; what is dear to build lives in a module of its own in the worker instead. Of such
    objects the worker keeps the ``KEPT`` used last, so that stages do not add up in memory.
    """
    holder = sys.modules.setdefault(HOLDER, types.ModuleType(HOLDER))
    kept = holder.__dict__.setdefault("kept", {})
    found = kept.pop(name, None)
    if found is None:
        while len(kept) >= KEPT:
            del kept[next(iter(kept))]
        found = make()
    kept[name] = found
    return found


class Memo(dict):
    """Values by key, computed when missing and dropped all at once at ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Recent(dict):
    """Values by key, of which at least the ``limit`` looked up last are remembered.

    Two generations: when the younger is full it becomes the older, and what was the older is
    dropped. Keys found there move back to the younger, so that those in use are never lost
    with those that are not. At most twice ``limit`` entries are held, or one call's keys more.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.older: dict = {}

    def unknown(self, keys: set) -> set:
        """The keys to compute and add; all others can be looked up until the next call."""
        absent = keys.difference(self)
        if len(self) + len(absent) > self.limit:
            self.older = dict(self)
            self.clear()
            absent = keys
        found = absent.intersection(self.older)
        self.update(zip(found, map(self.older.__getitem__, found)))
        return absent.difference(found)


def slices(
    batches: Iterable[pa.RecordBatch], text_at: int = 1, rows: int = 1000, size: int = 1 << 24
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds ``rows`` rows at most, and text of ``size`` bytes.

    A text longer than that is a slice of its own.
    """
    for batch in batches:
        texts = batch.column(text_at)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begun = 0
        while begun < batch.num_rows:
            sums = np.cumsum(lengths[begun : begun + rows])
            count = max(1, int(np.searchsorted(sums, size, side="right")))
            yield batch.slice(begun, count)
            begun += count
        # What Arrow holds back for itself counts as the worker's memory too.
        pa.default_memory_pool().release_unused()


def per_batch(
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` over every batch, in slices so that memory stays bounded.

    Where the second column holds texts, slices are bounded by their bytes too.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).type if batch.num_columns > 1 else None
            if kind is not None and (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
                yield from map(function, slices([batch]))
            else:
                for start in range(0, batch.num_rows, 1000):
                    yield function(batch.slice(start, 1000))

    return run


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def extended(schema: T.StructType, added: str) -> T.StructType:
    """``schema`` with the fields of a DDL string."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])


def bucket_of(column: Column, modulus: int) -> Column:
    """CRC-32 of the decimal text of an id, modulo ``modulus``; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
