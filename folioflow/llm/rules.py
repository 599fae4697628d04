"""Quality rules: counts of every text and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, extended, per_batch, quoted, texts_as_bytes, worker_cache

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Hash buckets of words and word pairs, and added count of each.
BUCKETS = 8192
ADDED = 1.0
# N-grams with the shares of all texts that are added to the trusted ones.
PULL = float(1 << 17)
# Mean log ratio per n-gram below which a text is rejected.
THRESHOLD = -0.06
# Trusted ids up to which they are broadcast; beyond, the texts are shuffled to them.
BROADCAST_IDS = 1_000_000
# Word hashes that a worker remembers, about 120 bytes each.
REMEMBERED = 1 << 18

_WHITE = bytes([0x20, *range(0x09, 0x0E)])
_TRAILING = bytes(range(0x80, 0xC0))


def word_hash(word: bytes) -> int:
    """The first four bytes of the word's MD5 as a number."""
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big")


def ngram_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours, repeats included."""
    known = worker_cache("word_hashes", lambda: Memo(word_hash, REMEMBERED))
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    return np.concatenate([hashes % buckets, (hashes[:-1] * 31 + hashes[1:]) % buckets])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included.

    Windows are numbered exactly, by numbering pairs of shorter windows, at powers of two.
    """
    count = len(words) - window + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)
    )
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = ids[:-step] << 32 | ids[step:]
        distinct, ids, often = np.unique(pairs, return_inverse=True, return_counts=True)
        width += step
        if len(distinct) == len(pairs):
            return 0
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(often[ids] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(marks)))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents labelled good, and never otherwise."""
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_low"))
        .filter("_low = 1")
        .select(F.col("doc_id").alias("_trusted"))
    )


def ngram_counts(
    docs: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the n-grams of all texts and those of trusted ones.

    Counts run over every row. Each task adds up its own buckets, so the shuffle carries at
    most ``buckets`` rows a task and the driver sees ``buckets`` rows.
    """
    size = trusted.limit(BROADCAST_IDS + 1).count()
    marked = F.broadcast(trusted) if size <= BROADCAST_IDS else trusted
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    rows = rows.join(marked, F.col("_id") == F.col("_trusted"), "left").select(
        "text", F.col("_trusted").isNotNull().alias("trusted")
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for text, good in zip(texts_as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = ngram_buckets((text or b"").split(), buckets)
                some = np.bincount(found, minlength=buckets)
                total[0] += some
                if good:
                    total[1] += some
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(total[0][seen]), pa.array(total[1][seen])],
            names=["bucket", "raw", "target"],
        )

    counted = (
        rows.mapInArrow(count, "bucket INT, raw BIGINT, target BIGINT")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
        .collect()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counted:
        raw[b], target[b] = r, t
    return raw, target


def pulled_ratios(
    docs: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    added: float = ADDED,
    pull: float = PULL,
) -> np.ndarray:
    """Per bucket the log of its share in trusted texts over its share in all texts.

    ``added`` goes to every bucket of all texts, and the trusted counts are pulled to their
    shares: ``pull`` n-grams that are spread like all texts are added to the trusted ones. Few
    trusted texts thus give ratios near 0, by which documents are kept, and none give 0
    throughout: without trusted texts the base rules alone decide.
    """
    raw, target = ngram_counts(docs, trusted, id_column, text_column, buckets)
    shares = (raw + added) / (raw.sum() + added * buckets)
    return np.log((target / shares + pull) / (target.sum() + pull))


def quality_rules(
    docs: DataFrame,
    ratios: np.ndarray,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All columns of ``docs`` with the counts, ``ratio``, ``base_failed`` and ``kept``.

    Added: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio`` (the mean log
    ratio of the text's n-grams, 0 without words), ``base_failed`` and ``kept``; columns of
    ``docs`` with these names are replaced. Null texts count as empty ones, which fail the base
    rules. One row per row, repeats included; an empty table gives no rows. Map-only.
    """
    buckets = len(ratios)
    added = (
        "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT,"
        " n_repeat_words BIGINT, ratio DOUBLE, base_failed BOOLEAN, kept BOOLEAN"
    )
    names = [c.split()[0] for c in added.split(", ")]
    carried = [c for c in docs.columns if c not in names]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names]
        for text in texts_as_bytes(batch.column(1)):
            text = text or b""
            words = text.split()
            found = ngram_buckets(words, buckets)
            ratio = float(ratios[found].mean()) if len(words) else 0.0
            repeated = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
            values = (
                len(words),
                len(text.translate(None, _WHITE + _TRAILING)),
                len(text) - len(text.translate(None, SYMBOLS)),
                repeated_lines(text),
                repeated,
                ratio,
                failed,
                not failed and ratio >= threshold,
            )
            for column, value in zip(columns, values):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.bool_()] * 2
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["_row", *names],
        )

    rows = docs.select(
        F.struct(*map(quoted, carried)).alias("_row"), F.col(text_column).alias("_text")
    )
    schema = extended(rows.select("_row").schema, added)
    return rows.mapInArrow(per_batch(run), schema).select("_row.*", *names)
