"""Guarded per-document map for callables Spark has no expression for, such as OCR engines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.schemas import TOKEN

from .tokens import FALLBACK_ENGINE, PRIMARY_ENGINE

OCR_RESULT = f"engine STRING, tokens ARRAY<{TOKEN}>"
OUTCOME = (
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("total_ms", T.DoubleType()),
    T.StructField("timings", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("started_at", T.DoubleType()),
    T.StructField("finished_at", T.DoubleType()),
)
# Rows handed back to the JVM at a time, so that large results do not pile up in the worker.
ROWS_PER_BATCH = 64


@dataclass
class Task:
    """What a document function gets besides its row: the shared model and a step timer."""

    model: Any = None
    timings: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str):
        begun = time.perf_counter()
        try:
            yield
        finally:
            self.timings[name] = round((time.perf_counter() - begun) * 1000, 2)


def map_documents(
    documents: DataFrame,
    function: Callable[[dict, Task], dict],
    schema: str | T.StructType,
    setup: Callable[[], Any] | None = None,
    keep: tuple[str, ...] = ("doc_id", "source_path"),
) -> DataFrame:
    """Apply ``function(row, task)`` to every row; a failing row becomes a failed result.

    ``schema`` describes the returned dict. Output columns: ``keep``, those of ``schema`` (null
    on failure), then ``success, error, total_ms, timings`` and the clock at start and end in
    seconds. Values reach the function as plain Python objects, integers with nulls included.
    ``setup`` loads a model once per task; an exception there fails the task, as no row could
    succeed.
    """
    produced = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [documents.schema[name] for name in keep]
    output = T.StructType([*kept, *produced.fields, *OUTCOME])
    names = [f.name for f in output.fields]
    empty = {f.name: None for f in produced.fields}

    def guarded(row: dict, model: Any) -> dict:
        task = Task(model)
        started_at, begun = time.time(), time.perf_counter()
        try:
            result = {**empty, **function(row, task), "success": True, "error": None}
        except Exception as problem:  # isolating any document failure is the purpose
            result = {**empty, "success": False, "error": str(problem)}
        result["total_ms"] = round((time.perf_counter() - begun) * 1000, 2)
        result["timings"] = task.timings
        result["started_at"], result["finished_at"] = started_at, time.time()
        result.update((name, row[name]) for name in keep)
        return result

    maps = [f.name for f in output.fields if isinstance(f.dataType, T.MapType)]
    arrow = to_arrow_schema(output)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        for row in rows:
            row.update((n, list(row[n].items())) for n in maps if isinstance(row[n], dict))
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    def checked(row: dict) -> dict:
        """The row, or its failure where a value does not fit the schema."""
        try:
            packed([dict(row)])
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as problem:
            return {**row, **empty, "success": False, "error": str(problem)}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = setup() if setup else None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                rows = batch.slice(start, ROWS_PER_BATCH).to_pylist()
                done = [{n: r.get(n) for n in names} for r in (guarded(row, model) for row in rows)]
                try:
                    yield packed([dict(r) for r in done])
                except (pa.ArrowException, TypeError, ValueError, OverflowError):
                    yield packed([checked(r) for r in done])

    return documents.mapInArrow(run, output)


def first_with_tokens(
    primary: Callable[[dict, Task], list],
    secondary: Callable[[dict, Task], list],
    engine: str = PRIMARY_ENGINE,
    fallback: str = FALLBACK_ENGINE,
) -> Callable[[dict, Task], dict]:
    """A function for ``map_documents`` with the schema ``OCR_RESULT`` from two OCR callables.

    Each returns a list of ``{text, confidence, bbox}``. The second one runs only for pages on
    which the first fails or finds nothing; a failing engine counts as finding nothing.
    """

    def found_by(callable_: Callable[[dict, Task], list], row: dict, task: Task) -> list:
        try:
            return callable_(row, task)
        except Exception:  # the other engine, or an empty page, takes its place
            return []

    def read(row: dict, task: Task) -> dict:
        tokens = found_by(primary, row, task)
        if tokens:
            return {"engine": engine, "tokens": tokens}
        return {"engine": fallback, "tokens": found_by(secondary, row, task)}

    return read


def spread_documents(documents: DataFrame, key: str, tasks: int) -> DataFrame:
    """Even out documents over ``tasks`` tasks before a costly map; ``key`` must be unique."""
    return documents.repartition(tasks, F.col(key))


def number_documents(images: DataFrame, order: str) -> DataFrame:
    """Name unnamed items ``image_<position>`` after their position column."""
    return images.withColumn(
        "source_path", F.coalesce("source_path", F.format_string("image_%d", F.col(order)))
    )


def document_id(source_path: str = "source_path", random: bool = False):
    """Id column: a digest of the path, the same on every retry; ``random=True`` for a UUID."""
    return F.uuid() if random else F.sha2(F.col(source_path), 256)
