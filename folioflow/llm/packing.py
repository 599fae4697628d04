"""Documents as token pieces, packed into as few fixed-size sequences as possible."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import Recent, extended, quoted, slices, texts_as_bytes, worker_cache

CAPACITY = 4096
END_ID = 1
# Runs of letters that a worker remembers, about 40 bytes each, and other words, about 200 bytes
# each of up to twice as many.
REMEMBERED_RUNS = 3 << 17
REMEMBERED = 1 << 15
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
# Lower-case letters of which a plain word is made.
LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)))
# First bytes of combining marks, before which a change of case is no safe step.
COMBINING = (b"\xcc", b"\xcd")
# Text that is taken apart at once.
SLICE_ROWS, SLICE_BYTES = 1000, 1 << 22
# Groups that large lengths are rounded in, and the share of a sequence up to which a length
# counts as small.
GROUPS = 48
SMALL_SHARE = 3
# Rows ranked in one task: at least so many, and no more buckets than this in all.
BUCKET_ROWS = 128
BUCKETS = 1 << 14


class RunTable:
    """Ids of runs remembered as columns, far smaller than a dictionary of them.

    Runs used since the table was last cut down survive the next time it is, which happens
    when it holds more than ``limit``; so those in use are never dropped with the others. It
    holds ``limit`` runs and those of two calls at most.
    """

    def __init__(self, limit: int):
        self.limit = limit
        # The empty run comes first, has no ids, and always stays.
        self.runs = pa.array([""], pa.string())
        self.sizes = np.zeros(1, dtype=np.int64)
        self.ids = np.empty(0, dtype="<u4")
        self.used = np.ones(1, dtype=bool)

    def cut_down(self) -> None:
        kept = np.flatnonzero(self.used)
        self.ids, _ = gathered(self.ids, self.sizes, kept)
        self.runs, self.sizes = self.runs.take(pa.array(kept)), self.sizes[kept]
        self.used = np.zeros(len(kept), dtype=bool)
        self.used[0] = True

    def places(
        self, runs: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    ) -> np.ndarray:
        """Where each run stands in the table; ``learn`` gives ids and sizes of unknown ones."""
        if len(self.runs) > self.limit:
            self.cut_down()
        found = pc.index_in(runs, value_set=self.runs)
        absent = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        places = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(absent):
            unknown = runs.take(pa.array(absent))
            fresh = unknown.unique()
            ids, sizes = learn(fresh.to_pylist())
            places[absent] = len(self.runs) + pc.index_in(unknown, value_set=fresh).to_numpy()
            self.runs = pa.concat_arrays([self.runs, fresh.cast(pa.string())])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), dtype=bool)])
        self.used[places] = True
        return places


class WordTokenizer:
    """Ids of texts by the library, word by word.

    For tokenizers that drop white space, cut words at it, lower letters and keep a run of
    letters or of punctuation together: the ids of a text are then those of its words in
    turn, and those of a plain word are the ids of its letters and of what follows them. Words
    are taken apart by column; only the distinct runs of some texts are looked up, and those
    not remembered go to the library many at a time.
    """

    def __init__(self, definition: bytes):
        self.library = library = Tokenizer.from_str(definition.decode())
        added = library.get_added_tokens_decoder()
        self.mark_id, mark = min((i, str(t.content)) for i, t in added.items() if t.special)
        self.mark = mark.encode()
        # What a change of letters could turn into a special token, or keep from composing.
        self.unsafe = (self.mark[:2], *COMBINING)
        suffix = library.model.end_of_word_suffix
        self.ends = np.zeros(library.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in library.get_vocab(False).items() if t.endswith(suffix)]] = True
        # The same without what only texts need: runs are lower-case and apart already.
        self.plain = Tokenizer.from_str(definition.decode())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        for probe, parts in (
            ("a  bc.d\n", ("a", "bc.d")),
            ("Bc.,", ("bc", ".,")),
            ("ABé", ("abé",)),
        ):
            if self.ids(probe.encode()) != b"".join(self.ids(p.encode()) for p in parts):
                raise ValueError("the tokenizer does not cut texts as expected")
        probe = "word être größer ., <>#"
        if self.ids(probe.encode()) != self.ids_of_runs(probe):
            raise ValueError("the tokenizer does not take runs as expected")
        self.words: Recent[bytes, bytes] = Recent(REMEMBERED)
        self.runs = RunTable(REMEMBERED_RUNS)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        found = self.library.encode(text.decode(errors="replace"), add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    def ids_of_runs(self, runs: str) -> bytes:
        (found,) = self.plain.encode_batch_fast([runs], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4").tobytes()

    @staticmethod
    def cut(ids: bytes, starts: np.ndarray, stops: np.ndarray) -> Iterator[bytes]:
        return map(ids.__getitem__, map(slice, (4 * starts).tolist(), (4 * stops).tolist()))

    def learned_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each run is one word to the library, so its last id is one that ends a word."""
        found, sizes = [], []
        for begun in range(0, len(runs), 512):
            some = runs[begun : begun + 512]
            ids = np.frombuffer(self.ids_of_runs(" ".join(some)), "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end words as expected")
            found.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def learn_words(self, words: list[bytes]) -> None:
        """Words of any kind, with a special token between them."""
        for begun in range(0, len(words), 512):
            some = words[begun : begun + 512]
            ids = self.ids(self.mark.join(some))
            marks = np.flatnonzero(np.frombuffer(ids, "<u4") == self.mark_id)
            starts, stops = np.append(0, marks + 1), np.append(marks, len(ids) // 4)
            self.words.update(zip(some, self.cut(ids, starts, stops)))

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any kind, special tokens within them included."""
        fresh = self.words.unknown(set(words))
        marked = [w for w in fresh if self.mark in w]
        self.words.update((w, self.ids(w)) for w in marked)
        self.learn_words(list(fresh.difference(marked)))
        return [self.words[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls) in a row, and where each text starts."""
        if not any(pc.any(pc.match_substring(texts, u)).as_py() for u in self.unsafe):
            texts = pc.ascii_lower(texts)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary
        # A plain word is letters and then punctuation, so these two make up all of it.
        runs = pc.utf8_rtrim(distinct, characters=PUNCTUATION)
        tails = pc.utf8_ltrim(distinct, characters=LETTERS)
        sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (distinct, runs, tails)]
        plain = (sizes[1] > 0) & (sizes[1] + sizes[2] == sizes[0])
        kept = pa.array(plain)
        both = pa.concat_arrays([runs.filter(kept), tails.filter(kept)])
        at = self.runs.places(both, self.learned_runs)
        others = self.ids_of_words(texts_as_bytes(distinct.filter(pa.array(~plain))))
        # Two pieces make each distinct word; that of another word is the empty run.
        pair = np.zeros((len(distinct), 2), dtype=np.int64)
        pair[plain] = at.reshape(2, -1).T
        pair[~plain, 0] = np.arange(len(others)) + len(self.runs.runs)
        more = np.fromiter(map(len, others), np.int64, len(others)) // 4
        sizes = np.concatenate([self.runs.sizes, more])
        ids = np.concatenate([self.runs.ids, np.frombuffer(b"".join(others), "<u4")])
        flat, ends = gathered(ids, sizes, pair.reshape(-1))
        whole, stops = gathered(
            flat, np.diff(ends[::2]), words.indices.to_numpy(zero_copy_only=False)
        )
        counts = cut.value_lengths().to_numpy(zero_copy_only=False)
        return whole, stops[np.append(0, np.cumsum(counts))]


def gathered(
    flat: np.ndarray, sizes: np.ndarray, chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones of neighbouring stretches of ``flat`` in a row, and their bounds."""
    lengths = sizes[chosen]
    bounds = np.append(0, np.cumsum(lengths))
    shift = (np.cumsum(sizes) - sizes)[chosen] - bounds[:-1]
    places = np.repeat(shift.astype(np.int32), lengths)
    places += np.arange(len(places), dtype=np.int32)
    return flat[places], bounds


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids`` (binary, little-endian unsigned 32-bit).

    A document is the ids of its whole text, none for null, then ``end_id``; only a document
    longer than ``capacity`` is cut. Repeated rows and null ids give pieces of their own, an
    empty table none. Map-only; other columns are not read.
    """
    definition = Path(tokenizer_path).read_bytes()
    ending = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(
            f"words_{zlib.crc32(definition)}", lambda: WordTokenizer(definition)
        )
        for batch in slices(batches, 1, SLICE_ROWS, SLICE_BYTES):
            texts = pc.fill_null(batch.column(1), "")
            rows, numbers, pieces = [], [], []
            flat, starts = tokenizer.encode(texts)
            whole = flat.tobytes()
            for i, (a, b) in enumerate(zip((4 * starts).tolist(), (4 * starts[1:]).tolist())):
                ids = whole[a:b] + ending
                for k, at in enumerate(range(0, len(ids), step)):
                    rows.append(i)
                    numbers.append(k)
                    pieces.append(ids[at : at + step])
            places = np.array(numbers, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(places),
                    pa.array(places.astype(np.int64) * capacity),
                    pa.array([len(p) // 4 for p in pieces], pa.int64()),
                    pa.array(pieces, pa.binary()),
                ],
                names=["id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, piece INT, start BIGINT, length BIGINT, ids BINARY"
    )


def fractional_patterns(
    sizes: np.ndarray, demand: np.ndarray, capacity: int
) -> list[tuple[np.ndarray, float]]:
    """Patterns (how many of each size) and how often to use them, covering the demand.

    The configuration programme over few sizes, solved by adding the pattern of best price
    (a knapsack over capacities) until none improves.
    """
    count = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(60 * count):
        inverse = np.linalg.inv(basis)
        use = inverse @ demand
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        taken = np.full(capacity + 1, -1)
        # Each size in turn, as often as it fits; equal values keep the earlier choice.
        for i in np.argsort(-price / sizes, kind="stable"):
            if price[i] <= 0:
                continue
            for room in range(sizes[i], capacity + 1, sizes[i]):
                stop = min(room + sizes[i], capacity + 1)
                value = best[room - sizes[i] : stop - sizes[i]] + price[i]
                better = value > best[room:stop] + 1e-12
                best[room:stop][better] = value[better]
                taken[room:stop][better] = i
        room = int(np.argmax(best))
        if best[room] <= 1 + 1e-9:
            break
        pattern = np.zeros(count)
        while room > 0 and taken[room] >= 0:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
        column = inverse @ pattern
        ratio = np.full(count, np.inf)
        ratio[column > 1e-9] = use[column > 1e-9] / column[column > 1e-9]
        basis[:, int(np.argmin(ratio))] = pattern
    use = np.linalg.inv(basis) @ demand
    return [(basis[:, i].round().astype(int), float(use[i])) for i in range(count)]


class Layout:
    """Runs of equal lengths placed in runs of sequences.

    A run says that the items of one length with ranks ``first`` up to ``last`` go to
    sequences from ``sequence`` on, ``each`` of them side by side from ``offset``.
    """

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.rank = np.zeros(len(counts), dtype=np.int64)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        first = int(self.rank[length])
        self.runs.append((length, first, first + count, sequence, each, offset))
        self.rank[length] += count
        self.left[length] -= count

    def opened(self, copies: int) -> int:
        self.sequences += copies
        return self.sequences - copies

    def leave(self, gap: int, sequence: int, copies: int) -> None:
        if gap and copies:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((sequence, copies))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        sequence, copies = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap], self.gaps[at]
        return gap, sequence, copies

    def substitute(self, pattern: list[int], copies: int, quota: list[dict[int, int]]) -> None:
        """Fill ``copies`` of a pattern of groups with the groups' actual lengths, longest first.

        ``quota`` holds what is left of each length in each group, and is drawn down.
        """
        slots = []
        for group, times in enumerate(pattern):
            for _ in range(times):
                slot, wanted = [], copies
                for length in quota[group]:
                    take = min(wanted, quota[group][length])
                    if take:
                        quota[group][length] -= take
                        slot.append((length, take))
                        wanted -= take
                    if not wanted:
                        break
                slots.append(slot)
        self._lay(slots)

    def _lay(self, slots: list[list[tuple[int, int]]]) -> None:
        at = [0] * len(slots)
        rest = [slot[0][1] for slot in slots]
        while all(a < len(s) for a, s in zip(at, slots)):
            copies = min(rest)
            sequence, offset = self.opened(copies), 0
            for k, slot in enumerate(slots):
                length = slot[at[k]][0]
                self.place(length, copies, sequence, 1, offset)
                offset += length
                rest[k] -= copies
                if not rest[k]:
                    at[k] += 1
                    rest[k] = slot[at[k]][1] if at[k] < len(slot) else 0
            self.leave(self.capacity - offset, sequence, copies)

    def best_fit(self) -> None:
        """The lengths still left, longest first, each into the smallest gap that holds it."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                found = self.tightest(length)
                count = int(self.left[length])
                if found is None:
                    each = self.capacity // length
                    copies = -(-count // each)
                    found = self.capacity, self.opened(copies), copies
                gap, sequence, copies = found
                each = gap // length
                full = min(copies, count // each)
                offset = self.capacity - gap
                if full:
                    self.place(length, full * each, sequence, each, offset)
                    self.leave(gap - each * length, sequence, full)
                rest = min(count - full * each, each) if full < copies else 0
                if rest:
                    self.place(length, rest, sequence + full, rest, offset)
                    self.leave(gap - rest * length, sequence + full, 1)
                used = full + bool(rest)
                self.leave(gap, sequence + used, copies - used)


def plan(counts: np.ndarray, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> Layout:
    """Where every length goes, from ``counts[length]`` alone.

    Large lengths are sorted, put into groups of equal cardinality and rounded up to the
    largest of their group; whole multiples of the best patterns over the few rounded sizes
    are filled with the actual lengths, and everything left goes by best fit, longest first.
    """
    layout = Layout(counts)
    capacity = layout.capacity
    large = [n for n in range(capacity, capacity // small_share, -1) if counts[n]]
    total = int(sum(counts[n] for n in large))
    if total:
        share = -(-total // groups)
        quota: dict[int, dict[int, int]] = {}
        size, room = 0, 0
        for length in large:
            wanted = int(counts[length])
            while wanted:
                if not room:
                    size, room = length, share
                take = min(wanted, room)
                # Groups that round up to the same size are one.
                group = quota.setdefault(size, {})
                group[length] = group.get(length, 0) + take
                wanted, room = wanted - take, room - take
        left = list(quota.values())
        demand = np.array([sum(g.values()) for g in left], dtype=float)
        for pattern, use in fractional_patterns(np.array(list(quota)), demand, capacity):
            copies = int(use + 1e-9)
            for group, times in zip(left, pattern.tolist()):
                if times:
                    copies = min(copies, sum(group.values()) // times)
            if copies > 0:
                layout.substitute(pattern.tolist(), copies, left)
    layout.best_fit()
    return layout


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    length_column: str = "length",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, all lengths from 1 to ``capacity``.

    The driver sees counts per length, at most ``capacity`` rows, and plans on them; a piece
    finds its place by its rank among the pieces of its length. A length that many pieces
    share is ranked in many buckets, whose number is bounded, with offsets counted on the
    driver. ``pieces`` is read three times, so store it before. Repeated rows are pieces of
    their own; an empty table gives no rows. Null lengths and lengths beyond the capacity are
    an error. Equal rows may swap places, no others.
    """
    sizes = {r[0]: r[1] for r in pieces.groupBy(length_column).count().collect()}
    if any(n is None or not 1 <= n <= capacity for n in sizes):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in sizes.items():
        counts[n] = c
    layout = plan(counts, groups)
    runs = np.array(sorted(layout.runs), dtype=np.int64).reshape(-1, 6)

    rows = max(BUCKET_ROWS, -(-int(counts.sum()) // BUCKETS))
    spark = pieces.sparkSession
    # One row per length: bounded by the capacity.
    cuts = spark.createDataFrame(
        [(n, int(-(-c // rows))) for n, c in sizes.items()], "_length LONG, _buckets LONG"
    )
    whole = pieces.select(
        F.struct(*map(quoted, pieces.columns)).alias("_row"),
        F.col(length_column).cast("bigint").alias("_size"),
    )
    bucketed = (
        whole.join(F.broadcast(cuts), F.col("_size") == F.col("_length"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets")))
        .drop("_buckets", "_size")
    )
    # Bounded by BUCKETS plus one per length.
    held = sorted(
        (r[0], r[1], r[2]) for r in bucketed.groupBy("_length", "_bucket").count().collect()
    )
    before, last, offsets = 0, None, []
    for n, b, c in held:
        before = 0 if n != last else before
        offsets.append((n, b, before))
        before, last = before + c, n
    table = np.array(offsets, dtype=np.int64).reshape(-1, 3)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_keys = table[:, 0] << 40 | table[:, 1]
        run_keys = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length = batch.column("_length").to_numpy()
            bucket = batch.column("_bucket").to_numpy()
            rank = batch.column("_rank").to_numpy() - 1
            rank = rank + table[np.searchsorted(bucket_keys, length << 40 | bucket), 2]
            found = runs[np.searchsorted(run_keys, length << 44 | rank, side="right") - 1]
            place = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"),
                    pa.array(found[:, 3] + place // found[:, 4]),
                    pa.array(found[:, 5] + place % found[:, 4] * length),
                ],
                names=["_row", "sequence_id", "offset"],
            )

    ranked = bucketed.withColumn(
        "_rank",
        F.row_number()
        .over(Window.partitionBy("_length", "_bucket").orderBy("_row"))
        .cast("bigint"),
    )
    schema = extended(whole.select("_row").schema, "sequence_id BIGINT, offset BIGINT")
    return ranked.mapInArrow(run, schema).select("_row.*", "sequence_id", "offset")
