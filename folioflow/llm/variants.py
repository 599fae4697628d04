"""Spelling variants: a vocabulary and its words one edit apart, by bit-sliced letter positions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, broadcast_if_few, slices, texts_as_bytes, worker_cache, written
from .graph import resolved

FEWEST_LETTERS = 5
FEWEST_USES = 3
# Of so many pairs of document and word one loses a letter.
DROPPED = 97
# A form is used at least so many times as often as its variant.
RATIO = 2
# Counted words that a task gathers before it passes them on, and split texts it remembers.
HELD_WORDS = 1 << 18
REMEMBERED = 1 << 17
# Words compared at once; larger buckets are cut in chunks. Letters in a block at most, beyond
# which longer words go in smaller blocks.
CHUNK = 512
BLOCK_LETTERS = 1 << 20
# Large buckets up to which they are broadcast, about 40 bytes each; more are joined by shuffle.
BROADCAST_BUCKETS = 1 << 18

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in range(256)
)
# Letters of the runs, lower case but for letters beyond ASCII: C3 leads U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def letter_runs(text: bytes | None) -> Counter:
    """How often each run ``[A-Za-z\\u00C0-\\u00FF]+`` occurs, only A-Z in lower case."""
    found = Counter((text or b"").translate(_PLAIN).split())
    beyond = [w for w in found if not w.isascii()]
    if beyond:
        split = worker_cache("letter_runs", lambda: Memo(_RUN.findall, REMEMBERED))
        for word in beyond:
            runs = split[word]
            if runs != [word]:
                count = found.pop(word)
                for run in runs:
                    found[run] += count
    return found


def document_words(ident: bytes, text: bytes | None) -> Iterator[tuple[bytes, int]]:
    """Words of a document with their counts; one in ``DROPPED`` runs lacks a letter.

    The CRC-32 of ``<id>:<run>`` says which, and which letter. Words of fewer than
    ``FEWEST_LETTERS`` letters are left out.
    """
    start = zlib.crc32(ident + b":")
    for run, count in letter_runs(text).items():
        if len(run) < FEWEST_LETTERS:
            continue
        chance = zlib.crc32(run, start)
        if not chance % DROPPED:
            letters = run.decode()
            at = chance % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        if len(run) >= 2 * FEWEST_LETTERS or len(run.decode()) >= FEWEST_LETTERS:
            yield run, count


def _counted(held_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            words = pa.array(list(total), pa.binary()).cast(pa.string())
            counts = pa.array(list(total.values()), pa.int64())
            total.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in slices(batches, 1):
            for ident, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1))):
                for word, count in document_words((ident or "").encode(), text):
                    total[word] = total.get(word, 0) + count
                if len(total) >= held_words:
                    yield flushed()
        yield flushed()

    return run


def vocabulary(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    fewest_uses: int = FEWEST_USES,
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """``word, n`` of all words used ``fewest_uses`` times or more over all whole texts.

    Each task adds up its own counts before the shuffle and holds a bounded number of words.
    Null and empty texts have no words; a null id counts as an empty one. Repeated rows count
    again. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    return (
        rows.mapInArrow(_counted(held_words), "word STRING, n BIGINT")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= fewest_uses)
    )


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, the first flag lowest."""
    spare = -bits.shape[-1] % 64
    if spare:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], spare), dtype=bool)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class PositionIndex:
    """Per position and letter the set of words that have the letter there, as bits.

    Words of one block are lanes. Sets of a position are made when the recurrences reach it,
    and three neighbouring positions are kept, so the index takes as much memory as the
    alphabet of three positions, however long the words are.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths
        self.sets: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray] = {}

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each given letter the words that have it at the position."""
        if position not in self.sets:
            self.sets.pop(position - 3, None)
            self.places.pop(position - 3, None)
            column = self.codes[:, position]
            known = np.unique(column[column >= 0])
            flags = np.vstack([column == known[:, None], np.zeros((1, len(column)), dtype=bool)])
            self.places[position] = known
            self.sets[position] = packed(flags)
        known = self.places[position]
        row = np.searchsorted(known, letters)
        missing = np.append(known, -1)[row] != letters
        return self.sets[position][np.where(missing, len(known), row)]


def near_words(
    codes: np.ndarray, lengths: np.ndarray, least: int, groups: np.ndarray, sides: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, near word) of positions in a block, both ways round.

    ``codes`` holds the words' letters, -1 beyond their ends; lengths are m (``least``) and
    m + 1, and words are near if one has one letter replaced among those of m, or inserted
    between m and m + 1. Only words of one group meet; those of sides 0 and 1 only across. For all words at
    once, letter after letter: ``none`` is the set of words equal so far, ``replaced`` those
    with one letter replaced, ``longer`` those with a letter more (read one position on) and
    ``shorter`` those with a letter less (read one position back).
    """
    count = len(lengths)
    index = PositionIndex(codes, lengths)
    of_length = {m: packed((lengths == m)[None, :]) for m in (least, least + 1)}
    allowed = groups[:, None] == groups[None, :]
    np.fill_diagonal(allowed, False)
    allowed &= (sides[:, None] == 2) | (sides[:, None] != sides[None, :])
    start = packed(allowed)
    found: list[np.ndarray] = []
    for m in (least, least + 1):
        words = np.flatnonzero(lengths == m)
        none = start[words]
        replaced, longer, shorter = (np.zeros_like(none) for _ in range(3))
        for i in range(m):
            if not len(words):
                break
            letters = codes[words, i]
            here = index.at(i, letters)
            if m == least:
                replaced = (replaced & here) | (none & ~here)
                if i + 1 < codes.shape[1]:
                    longer = (longer | none) & index.at(i + 1, letters)
            else:
                shorter = (shorter & index.at(i - 1, letters) if i else shorter) | none
            none = none & here
            if i % 4 == 3:
                open_words = (none | replaced | longer | shorter).any(axis=1)
                if not open_words.all():
                    words, none, replaced, longer, shorter = (
                        x[open_words] for x in (words, none, replaced, longer, shorter)
                    )
        if m == least:
            near = (replaced & of_length[least]) | ((longer | none) & of_length[least + 1])
        else:
            near = shorter & of_length[least]
        flags = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little", count=count)
        row, lane = np.nonzero(flags)
        found.append(np.stack([words[row], lane]))
        index.sets.clear()
        index.places.clear()
    left, right = np.concatenate(found, axis=1)
    return left, right


def letter_codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words, -1 beyond their ends."""
    codes = np.full((len(words), width), -1, dtype=np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    codes[np.arange(width) < lengths[:, None]] = flat
    return codes


def _best_of_block(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each word of some buckets of one class how many are near, and the best of them.

    The best is the most used, of equals the first by code points. A pair counts where its
    beginnings meet, and by its ends only if its beginnings differ, so it counts once.
    """
    words, uses = table["word"].to_pylist(), table["n"].to_numpy()
    size = int(table["size"][0].as_py())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    left, right = near_words(
        letter_codes(words, size + 1), lengths, size, groups, table["side"].to_numpy()
    )
    by_end, half = table["by_end"].to_pylist(), size // 2
    counts: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}
    for a, b in zip(left.tolist(), right.tolist()):
        same = words[a][:half] == words[b][:half]
        if by_end[a] == by_end[b] != same:
            candidate = (-int(uses[b]), words[b])
            counts[a] = counts.get(a, 0) + 1
            best[a] = min(best.get(a, candidate), candidate)
    if best:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[a] for a in best], pa.string()),
                pa.array([counts[a] for a in best], pa.int64()),
                pa.array([less for less, _ in best.values()], pa.int64()),
                pa.array([near for _, near in best.values()], pa.string()),
            ],
            names=["word", "n_near", "less", "near"],
        )


def _compared(chunk: int, block_letters: int):
    """Rows sorted by class and bucket to blocks of buckets of one class, each compared whole."""
    keys = ("size", "key", "first", "second")

    def blocks(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """All buckets known to be whole; what is left is returned."""
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        group = np.cumsum(change)
        starts = np.append(0, np.flatnonzero(change))
        # The last bucket may go on.
        done = table.num_rows if last else int(starts[-1])
        # Words alone in their buckets meet none.
        kept = np.flatnonzero(np.bincount(group)[group[:done]] > 1)
        rest = table.slice(done)
        table, group = table.take(pa.array(kept)).combine_chunks(), group[kept]
        sizes = table["size"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        begun = 0
        while begun < len(group):
            limit = max(2, min(chunk, block_letters // (int(sizes[begun]) + 1)))
            fits = np.searchsorted(ends, begun + limit, side="right")
            class_end = np.searchsorted(sizes, sizes[begun], side="right")
            stop = max(
                int(ends[np.searchsorted(ends, begun, side="right")]),
                min(int(ends[max(0, fits - 1)]), int(class_end)),
            )
            yield from _best_of_block(table.slice(begun, stop - begun), group[begun:stop])
            begun = stop
        return rest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows >= 8 * chunk:
                held = yield from blocks(held, False)
        if held is not None and held.num_rows:
            yield from blocks(held, True)

    return run


def near_summary(
    words: DataFrame, chunk: int = CHUNK, block_letters: int = BLOCK_LETTERS
) -> DataFrame:
    """``word, n_near, form, form_n``: how many words of the table are one edit away, and which
    of those is used most (of equals the first by code points). Words without one are left out.

    ``words`` is ``word, n`` without repeats. Two words one edit apart with m letters in the
    shorter share their first m // 2 letters or their last m - m // 2, so a word meets others
    in four buckets: as one of m and as one of m + 1 letters, by its beginning and by its end.
    Buckets of more words than a block holds are cut in chunks before they are shuffled, and
    every two chunks are a group of their own. No pair leaves a task: each group gives counts
    and its best per word, which are then combined.
    """
    size = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", size.alias("size")).filter(f"size >= {FEWEST_LETTERS}")
    half = F.floor(F.col("size") / 2).cast("int")
    begins = F.substr("word", F.lit(1), half)
    ends = F.substr("word", F.length("word") - (F.col("size") - half) + 1)

    def bucket(by_end: bool, part: Column) -> Column:
        key = F.xxhash64(F.lit(by_end), F.col("size"), part)
        return F.struct(F.lit(by_end).alias("by_end"), key.alias("key"))

    places = rows.select(
        "word", "n", "size", F.explode(F.array(bucket(False, begins), bucket(True, ends))).alias("_b")
    ).select("word", "n", "size", "_b.*")
    most = F.least(
        F.lit(chunk), F.greatest(F.lit(2), F.floor(F.lit(block_letters) / (F.col("size") + 1)))
    )
    large = written(
        places.groupBy("size", "key")
        .agg(F.count(F.lit(1)).alias("_rows"))
        # Two chunks meet in a block, so each may fill half of it.
        .select("size", "key", F.ceil(F.col("_rows") / F.floor(most / 2)).alias("_chunks"), "_rows")
        .filter(F.col("_rows") > most)
        .drop("_rows"),
        "variants-large",
    )
    large = broadcast_if_few(large, BROADCAST_BUCKETS)
    chunks = F.coalesce(F.col("_chunks"), F.lit(1))
    spread = (
        places.join(large, ["size", "key"], "left")
        .withColumn("_own", F.pmod(F.xxhash64("word"), chunks))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        .select(
            "size",
            "key",
            "by_end",
            F.least("_own", "_other").alias("first"),
            F.greatest("_own", "_other").alias("second"),
            F.when(F.col("_own") == F.col("_other"), 2)
            .otherwise((F.col("_own") > F.col("_other")).cast("int"))
            .alias("side"),
            "word",
            "n",
        )
    )
    group = ["size", "key", "first", "second"]
    found = (
        spread.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(
            _compared(chunk, block_letters), "word STRING, n_near BIGINT, less BIGINT, near STRING"
        )
    )
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("_best"))
        .select(
            "word",
            "n_near",
            F.col("_best.near").alias("form"),
            (-F.col("_best.less")).alias("form_n"),
        )
    )


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words`` (``word, n``).

    ``form`` is the most used near word if it is used ``ratio`` times as often as the word or
    more, else null, and ``root`` the word at the end of following forms, the word itself if
    it has none. An empty table gives no rows. ``words`` must hold each word once; it is read
    more than once, so store it before.
    """
    near = near_summary(words)
    near = near.withColumnRenamed("word", "_word")
    joined = words.join(near, F.col("word") == F.col("_word"), "left")
    often = F.col("form_n") >= ratio * F.col("n")
    formed = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(often, F.col("form")).alias("form"),
            F.when(often, F.col("form_n")).alias("form_n"),
        ),
        "variants-forms",
    )
    # Uses grow along the way, so it ends; each round doubles the jumps.
    ends = resolved(
        formed.filter("form IS NOT NULL").select(F.col("word").alias("a"), F.col("form").alias("b"))
    )
    return formed.join(ends, formed["word"] == ends["a"], "left").select(
        "word", "form", F.coalesce("b", "word").alias("root"), "n", "n_near", "form_n"
    )
