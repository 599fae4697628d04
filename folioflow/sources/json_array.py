"""The elements of large JSON arrays, read by blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import blocks_of, listed_files, opened

BLOCK_BYTES = 16 * 1024 * 1024
# Blocks whose states are put together at a time.
FAN = 1024
# Fixed values of the format: structural bytes and white space.
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = b'"\\,[]'
_STEP = np.zeros(256, dtype=np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_WHITE = b" \t\r\n"
_MARK = b"\xef\xbb\xbf"

ELEMENTS = "file STRING, begin BIGINT, element STRING"


@dataclass(frozen=True)
class State:
    """Where a scan stands: nesting depth, whether inside a string, whether after a backslash."""

    depth: int = 0
    inside: bool = False
    escape: bool = False


@dataclass(frozen=True)
class Change:
    """What some bytes do to any state, as a table by pending escape and by side.

    ``turns[e]`` tells whether a string's inside and outside swap, ``escapes[e]`` whether an
    escape is pending at the end, ``depths[e][s]`` by how much the depth changes.
    """

    turns: tuple[bool, bool]
    escapes: tuple[bool, bool]
    depths: tuple[tuple[int, int], tuple[int, int]]

    def after(self, state: State) -> State:
        e, s = int(state.escape), int(state.inside)
        return State(
            state.depth + self.depths[e][s], state.inside ^ self.turns[e], self.escapes[e]
        )

    def then(self, other: Change) -> Change:
        """This change and another after it."""
        turns, escapes, depths = [], [], []
        for e in (0, 1):
            ends = [self.after(State(0, bool(s), bool(e))) for s in (0, 1)]
            last = [other.after(end) for end in ends]
            turns.append(last[0].inside)
            escapes.append(last[0].escape)
            depths.append((last[0].depth, last[1].depth))
        return Change(tuple(turns), tuple(escapes), tuple(depths))

    def row(self) -> list[int]:
        return [*map(int, self.turns), *map(int, self.escapes), *self.depths[0], *self.depths[1]]

    @staticmethod
    def of(row: Iterable[int]) -> Change:
        a, b, c, d, *depths = row
        return Change((bool(a), bool(b)), (bool(c), bool(d)), (tuple(depths[:2]), tuple(depths[2:])))


class Scan:
    """The structure of some bytes, given the state before them."""

    def __init__(self, data: bytes, state: State):
        self.data = data
        values = np.frombuffer(data, dtype=np.uint8)
        quotes = values == QUOTE
        quotes[np.flatnonzero(quotes)] &= ~self._escaped(values, np.flatnonzero(quotes), state)
        # Outside a string from here on, for the byte itself: a closing quote counts as inside.
        turned = np.cumsum(quotes) & 1
        inside = (turned.astype(bool) ^ state.inside) | quotes
        self.inside_after = bool((turned[-1] if len(turned) else 0) ^ state.inside)
        self.step = np.where(inside, 0, _STEP[values]).astype(np.int64)
        self.depth = state.depth + np.cumsum(self.step)
        self.outside = ~inside
        self.values = values
        run = len(data) - len(data.rstrip(b"\\"))
        pending = run + (state.escape if run == len(data) else 0)
        self.state = State(
            int(self.depth[-1]) if len(data) else state.depth, self.inside_after, bool(pending & 1)
        )

    @staticmethod
    def _escaped(values: np.ndarray, places: np.ndarray, state: State) -> np.ndarray:
        """Which places follow an odd run of backslashes, the pending escape included."""
        slashes = values == BACKSLASH
        # Length of the run of backslashes that ends before each place.
        last_other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(values))))
        before = places - 1
        stop = np.where(before >= 0, last_other[np.maximum(before, 0)], -1)
        length = before - stop + np.where(stop < 0, int(state.escape), 0)
        return (length & 1).astype(bool)

    def separators(self) -> np.ndarray:
        """Places of the bytes that open, part and close the outermost array."""
        here = self.outside & (
            ((self.values == COMMA) & (self.depth == 1))
            | ((self.values == OPEN) & (self.depth == 1) & (self.step == 1))
            | ((self.values == CLOSE) & (self.depth == 0))
        )
        return np.flatnonzero(here)


def change_of(data: bytes) -> Change:
    """The change of state over some bytes, whatever the state before them."""
    table = {}
    for e in (False, True):
        for s in (False, True):
            table[e, s] = Scan(data, State(0, s, e)).state
    return Change(
        tuple(table[e, False].inside for e in (False, True)),
        tuple(table[e, False].escape for e in (False, True)),
        tuple(tuple(table[e, s].depth for s in (False, True)) for e in (False, True)),
    )


_CHANGES = ", ".join(f"c{i} BIGINT" for i in range(8))
_CHANGE_NAMES = [f"c{i}" for i in range(8)]


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with opened(r["path"]) as file:
                data = file.read_at(r["stop"] - r["begin"], r["begin"])
            rows.append(change_of(data).row())
        columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(8)]
        kept = ("path", "length", "block", "begin", "stop")
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), *columns], names=[*kept, *_CHANGE_NAMES]
        )


def _combined(table: pa.Table) -> pa.Table:
    """The change over all blocks of a group, in order."""
    rows = table.sort_by("block").to_pylist()
    total = Change.of([rows[0][n] for n in _CHANGE_NAMES])
    for row in rows[1:]:
        total = total.then(Change.of([row[n] for n in _CHANGE_NAMES]))
    made = {"path": [rows[0]["path"]], "block": [rows[0]["group"]]}
    made |= {n: [v] for n, v in zip(_CHANGE_NAMES, total.row())}
    return pa.table(made, schema=_GROUPS)


_GROUPS = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), *((n, pa.int64()) for n in _CHANGE_NAMES)]
)
_STATES = pa.schema(
    [
        ("path", pa.string()), ("block", pa.int64()),
        ("depth", pa.int64()), ("inside", pa.bool_()), ("escape", pa.bool_()),
    ]
)


def _states(table: pa.Table) -> pa.Table:
    """The state before each block of a group, from the state before the group."""
    rows = table.sort_by("block").to_pylist()
    state = State(rows[0]["depth"], rows[0]["inside"], rows[0]["escape"])
    found = []
    for row in rows:
        found.append(
            {
                "path": row["path"], "block": row["block"],
                "depth": state.depth, "inside": state.inside, "escape": state.escape,
            }
        )
        state = Change.of([row[n] for n in _CHANGE_NAMES]).after(state)
    return pa.Table.from_pylist(found, schema=_STATES)


def block_states(changes: DataFrame, fan: int = FAN) -> DataFrame:
    """``path, block, depth, inside, escape``: the state before every block.

    A prefix scan in two levels: the changes of each ``fan`` neighbouring blocks are put
    together, the states before those groups follow from one another within a file, and the
    states before the blocks from theirs. No task holds more than ``fan`` rows and the groups of
    one file, one for each ``fan`` blocks.
    """
    group = F.floor(F.col("block") / F.lit(fan)).cast("bigint")
    grouped = changes.select("path", "block", group.alias("group"), *_CHANGE_NAMES)
    totals = grouped.groupBy("path", "group").applyInArrow(
        _combined, f"path STRING, block BIGINT, {_CHANGES}"
    )
    state = "path STRING, block BIGINT, depth BIGINT, inside BOOLEAN, escape BOOLEAN"
    begun = totals.select(
        "*", F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("inside"),
        F.lit(False).alias("escape"),
    )
    before_groups = begun.groupBy("path").applyInArrow(_states, state)
    given = grouped.join(before_groups.withColumnRenamed("block", "group"), ["path", "group"])
    return given.groupBy("path", "group").applyInArrow(_states, state)


def first_byte(file: pa.NativeFile, length: int) -> bytes:
    """The first byte that is no white space, a byte order mark apart."""
    at = len(_MARK) if file.read_at(min(len(_MARK), length), 0) == _MARK else 0
    while at < length:
        data = file.read_at(min(1 << 10, length - at), at)
        at += len(data)
        if data := data.lstrip(_WHITE):
            return data[:1]
    return b""


def _elements(block_bytes: int):
    """The elements that begin in each block, each read to its end."""

    def in_block(row: dict) -> Iterator[tuple[str, int, bytes]]:
        with opened(row["path"]) as file:
            begin, first = row["begin"], first_byte(file, row["length"])
            if first == b"{" and begin == 0:
                yield row["path"], 0, file.read_at(row["length"], 0).removeprefix(_MARK)
            if first != b"[":
                return
            state = State(row["depth"], row["inside"], row["escape"])
            held: list[bytes] = []
            started, own = None, True
            while begin < row["length"]:
                size = min(row["stop"] - begin if own else block_bytes, row["length"] - begin)
                scan = Scan(file.read_at(size, begin), state)
                at = 0
                for place in scan.separators().tolist():
                    if started is not None:
                        yield row["path"], started, b"".join([*held, scan.data[at:place]])
                        held, started = [], None
                    if scan.depth[place] == 0:
                        return
                    if not own:
                        return
                    started, at = begin + place + 1, place + 1
                if started is None:
                    return
                held.append(scan.data[at:])
                begin, state, own = begin + size, scan.state, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pending, size = [], 0
                for found in in_block(row):
                    text = found[2].strip(_WHITE)
                    if text:
                        pending.append((*found[:2], text.decode(errors="replace")))
                        size += len(text)
                    if size >= block_bytes:
                        yield packed(pending)
                        pending, size = [], 0
                yield packed(pending)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "begin", "element"])

    return run


def array_elements(
    spark: SparkSession,
    path: str,
    block_bytes: int = BLOCK_BYTES,
    fan: int = FAN,
    glob: str | None = None,
) -> DataFrame:
    """``file, begin, element``: the elements of the JSON arrays in a file or folder, as text.

    A file may have any size and is read by many tasks. A first pass learns what each block
    does to the state of a scan (depth, in a string, after a backslash) whatever that is
    before it; these changes compose, so a prefix scan gives the state before each block. A
    second pass finds the elements that begin in each block and reads each to its end, beyond
    the block if need be, so an element is what a task must hold, and no more than that and
    a block. ``begin`` is where the element's text may begin, a place to order by. A file
    with one object instead gives that object, whole; files of another shape give no rows. A
    byte order mark is ignored. Invalid JSON gives unspecified elements, which do not parse.
    """
    files = listed_files(spark, path, glob)
    blocks, tasks = blocks_of(files, block_bytes)
    kept = "path STRING, length BIGINT, block BIGINT, begin BIGINT, stop BIGINT"
    changes = blocks.mapInArrow(_changes, f"{kept}, {_CHANGES}")
    states = block_states(changes, fan)
    # Few small rows, which would otherwise end up in few tasks.
    placed = blocks.join(states, ["path", "block"]).repartition(tasks, "path", "block")
    return placed.mapInArrow(_elements(block_bytes), ELEMENTS)
