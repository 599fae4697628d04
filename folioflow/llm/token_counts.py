"""Token counts by byte-pair merging, without making the tokens."""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_batch, texts_as_bytes, worker_cache
from .pieces import Vocabulary, as_pieces, model_bytes, segments

# Counts of distinct segments and of stretches in them that a worker remembers, about 110
# bytes each.
REMEMBERED = 1 << 20
REMEMBERED_STRETCHES = 1 << 19
TOKEN_LIMIT = 4096


def count_symbols(vocabulary: Vocabulary, text: str) -> int:
    """Tokens of a stretch that stands alone: its symbols less the merges made.

    The heap gives the lowest-ranked adjacent pair, the leftmost of equals; two lists link
    each symbol to its neighbours. A character without a piece counts as its bytes.
    """
    ranks, known, size = vocabulary.ranks, vocabulary.ids, len(text)
    heap = []
    for i in range(size - 1):
        rank = ranks.get(text[i : i + 2])
        if rank is not None:
            heap.append((rank, i, 2))
    merges = 0
    end = list(range(1, size + 1))  # where the symbol that begins here ends, 0 when merged
    start = list(range(-1, size))  # where the symbol that ends here begins
    start[1:] = range(size)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, length = pop(heap)
        middle = end[i]
        if not middle or middle == size or end[middle] != i + length:
            continue
        stop = i + length
        end[i], end[middle], start[stop] = stop, 0, i
        merges += 1
        if stop < size:
            rank = ranks.get(text[i : end[stop]])
            if rank is not None:
                push(heap, (rank, i, end[stop] - i))
        if i:
            before = start[i]
            rank = ranks.get(text[before:stop])
            if rank is not None:
                push(heap, (rank, before, stop - before))
    count = size - merges
    if not all(map(known.__contains__, text)):
        for i, c in enumerate(text):
            if end[i] == i + 1 and c not in known:
                count += len(c.encode()) - 1
    return count


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text, one row per input row.

    Null and empty texts have no tokens. Texts are cut where no piece can cross, and each
    worker remembers the counts of a bounded number of such segments; a text without spaces is
    one segment, merged in time n log n. Repeated rows and null ids are kept; an empty table
    gives no rows. Map-only: no shuffle, and other columns are not read.
    """
    model = model_bytes(model_path)

    def prepared() -> Memo:
        vocabulary = Vocabulary(model)
        part = Memo(lambda s: count_symbols(vocabulary, s), REMEMBERED_STRETCHES).__getitem__
        cut = vocabulary.stretches
        return Memo(lambda s: sum(map(part, cut(as_pieces(s)))), REMEMBERED)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = worker_cache(f"counts_{zlib.crc32(model)}", prepared).__getitem__
        texts = texts_as_bytes(batch.column(1))
        sizes = [len(t or b"") for t in texts]
        tokens = [sum(map(count, segments(t))) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ],
            names=["id", "n_bytes", "n_tokens", "over_limit"],
        )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN"
    return rows.mapInArrow(per_batch(run), schema)
