"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, per_batch, texts_as_bytes

# Shrinkage of a class covariance to the pooled one, and of the pooled one to its diagonal.
TO_POOLED = 0.3
TO_DIAGONAL = 0.05
RIDGE = 1e-4

STATISTICS = (
    "words",
    "word_length",
    "word_length_spread",
    "upper",
    "symbols",
    "sentence_ends",
    "commas",
    "digits",
    "exclamations",
    "distinct_words",
    "doubled_words",
    "repeated_lines",
    "line_length",
    "entropy",
)

_CLASSES = np.zeros((256, 8))
for _i, _members in enumerate(
    (
        range(65, 91),  # upper-case letters
        range(97, 123),  # lower-case letters
        range(128, 256),  # bytes of other characters
        b"#*$%&|<>@^~\\_={}[]/+`",
        b".?",
        b",;:",
        range(48, 58),
        b"!",
    )
):
    _CLASSES[list(_members), _i] = 1


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """Transformed statistics, one row per text; shares are on a bounded square-root scale."""
    rows = np.zeros((len(texts), len(STATISTICS)))
    histograms = np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        text = text or b""
        histograms[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        count = len(words)
        lengths = np.fromiter(map(len, words), dtype=float, count=count)
        lines = [x for x in text.split(b"\n") if x]
        rows[i, 0] = np.log1p(count)
        rows[i, 1] = np.log1p(lengths.mean()) if count else 0
        rows[i, 2] = np.log1p(lengths.std()) if count else 0
        rows[i, 9] = np.log((len(set(words)) + 1) / (count + 1)) / np.log(count + 2)
        rows[i, 10] = np.sqrt(sum(map(operator.eq, words, words[1:])) / (count + 1))
        rows[i, 11] = np.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0
        rows[i, 12] = np.log1p(len(text) / len(lines)) if lines else 0
    upper, lower, other, symbols, ends, commas, digits, shouts = (histograms @ _CLASSES).T
    size = histograms.sum(axis=1) + 1
    letters = upper + lower + other + 1
    rows[:, 3] = np.sqrt(upper / letters)
    for column, counts in ((4, symbols), (5, ends), (6, commas), (7, digits), (8, shouts)):
        rows[:, column] = np.sqrt(counts / size)
    share = histograms / size[:, None]
    rows[:, 13] = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    return rows


def document_statistics(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, statistics`` (array of doubles) of every whole text; null counts as empty.

    One row per row: repeated rows and null ids are kept, an empty table gives none. Other
    columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = statistics(texts_as_bytes(batch.column(1)))
        offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "statistics"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch(run), f"id {kind}, statistics ARRAY<DOUBLE>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of the classes 0 and 1."""

    means: np.ndarray
    whitening: np.ndarray
    constants: np.ndarray

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        terms = [
            c - 0.5 * np.square((values - m) @ w.T).sum(axis=1)
            for m, w, c in zip(self.means, self.whitening, self.constants)
        ]
        return terms[1] - terms[0]


def fit(
    rows: DataFrame,
    label_column: str = "quality",
    to_pooled: float = TO_POOLED,
    to_diagonal: float = TO_DIAGONAL,
) -> Discriminant | None:
    """The discriminant from ``statistics`` of all labelled rows; None if a class has none.

    Labels other than 0 and 1 teach nothing. A row that is there twice, such as a document
    with two labels, counts twice. Each task adds up counts, sums and products per class; the driver sees one number per
    class and pair of statistics.
    """
    size = len(STATISTICS)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy().reshape(-1, size)
            values = np.hstack([np.ones((len(values), 1)), values])
            labels = batch.column(1).to_numpy()
            for label in (0, 1):
                some = values[labels == label]
                total[label] += some.T @ some
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
            names=["place", "value"],
        )

    found = (
        rows.select("statistics", F.col(label_column).cast("int").alias("label"))
        .filter("label IN (0, 1)")
        .mapInArrow(moments, "place INT, value DOUBLE")
        .groupBy("place")
        .agg(F.sum("value"))
        .collect()
    )
    total = np.zeros(2 * (size + 1) ** 2)
    for place, value in found:
        total[place] = value
    total = total.reshape(2, size + 1, size + 1)
    counts = total[:, 0, 0]
    if not counts.all():
        return None
    means = total[:, 0, 1:] / counts[:, None]
    spread = [
        total[c, 1:, 1:] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)
    ]
    pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / counts.sum()
    diagonal = np.diag(np.diag(pooled)) + RIDGE * np.eye(size)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * diagonal
    whitening, constants = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - to_pooled) * spread[c] + to_pooled * pooled)
        whitening.append(np.linalg.inv(factor))
        constants.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whitening), np.array(constants))


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """``rows`` with ``score``, the probability of label 1 from ``statistics``.

    Without a model every score is 0.5. One row per row, repeats included; an empty table
    stays empty.
    """
    if model is None:
        return rows.withColumn("score", F.lit(0.5))
    carried = rows.columns
    at = carried.index("statistics")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(at).flatten().to_numpy().reshape(-1, len(STATISTICS))
        odds = np.clip(model.log_odds(values), -500, 500)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(1 / (1 + np.exp(-odds)))], names=[*carried, "score"]
        )

    return rows.mapInArrow(per_batch(run), extended(rows.schema, "score DOUBLE"))
