"""Exact encoding by a merge-type sentencepiece model through backtracking, and decoding."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, per_batch, slices, texts_as_bytes, worker_cache
from .pieces import SPACE, Vocabulary, as_pieces, model_bytes, segments

# Encoded segments, stretches of them, and tested pairs that a worker remembers.
REMEMBERED = 3 << 18
REMEMBERED_STRETCHES = 1 << 19
REMEMBERED_PAIRS = 1 << 18
# Rows and bytes of text that are encoded before their ids go on.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 21


class Encoder:
    """Encodes by taking the longest piece and stepping back where it cannot be right.

    A sequence of pieces is what merging would give exactly if merging the text of every two
    neighbours gives those two again. The automaton finds all pieces in a segment; from each
    place the longest that goes with the piece before is taken, and a place from which no
    piece leads on is marked in a bit field and never tried again.
    """

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.automaton = ahocorasick.Automaton()
        single = {c for p in self.vocabulary.ids for c in p}
        for piece in self.vocabulary.ids.keys() | single:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.agree = Memo(self.compatible, REMEMBERED_PAIRS)
        self.stretches = Memo(self.encoded_stretch, REMEMBERED_STRETCHES)
        self.segments = Memo(self.encoded, REMEMBERED)

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging the two together leaves just the two; the first may be empty."""
        return self.vocabulary.merged(pair[0] + pair[1]) == [p for p in pair if p]

    def encoded(self, segment: bytes) -> bytes:
        """The ids of a segment as little-endian 32-bit numbers."""
        cut = self.vocabulary.stretches(as_pieces(segment))
        return b"".join(map(self.stretches.__getitem__, cut))

    def encoded_stretch(self, text: str) -> bytes:
        if len(text) == 1:
            found = [text]
        elif SPACE * 2 in text:
            # Runs of spaces share one rank, so neighbours alone do not settle them.
            found = self.vocabulary.merged(text)
        else:
            found = self.backtrack(text)
        ids_of = self.vocabulary.ids_of
        return array("i", [i for p in found for i in ids_of(p)]).tobytes()

    def backtrack(self, text: str) -> list[str]:
        size, agree = len(text), self.agree
        starting: list[list[str]] = [[] for _ in range(size)]
        for stop, piece in self.automaton.iter(text):
            starting[stop + 1 - len(piece)].append(piece)  # longer ones come later
        open_places = (1 << (size + 1)) - 1
        chosen: list[str] = [""]
        tried: list[int] = []  # index of the chosen piece among those that start at its place
        at, index = 0, len(starting[0]) - 1
        while at < size:
            before, here = chosen[-1], starting[at]
            while index >= 0:
                piece = here[index]
                stop = at + len(piece)
                if open_places >> stop & 1 and agree[before, piece]:
                    break
                index -= 1
            if index >= 0:
                chosen.append(piece)
                tried.append(index)
                at = stop
                index = len(starting[at]) - 1 if at < size else -1
            else:
                if not tried:
                    raise ValueError("no sequence of pieces fits the stretch")
                open_places &= ~(1 << at)
                at -= len(chosen.pop())
                index = tried.pop() - 1
        return chosen[1:]

    def encode(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.segments.__getitem__, segments(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as the library decodes them, in UTF-8.

        Ids of whole pieces are put together here; where bytes, control pieces or unknown ids
        take part, which the library mends or leaves out, it decodes the list itself.
        """
        texts, whole = self.vocabulary.texts, self.vocabulary.whole
        if len(ids) and not (0 <= ids.min() and ids.max() < len(texts) and whole[ids].all()):
            return self.vocabulary.library.decode(ids.tolist()).encode()
        joined = b"".join(map(texts.__getitem__, ids.tolist()))
        return joined[1:] if joined.startswith(b" ") else joined


def _encoder(model: bytes) -> Encoder:
    return worker_cache(f"encoder_{zlib.crc32(model)}", lambda: Encoder(model))


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    flat = np.concatenate([np.empty(0, "<i4"), *ids])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat))
    return lists.cast(pa.list_(pa.int32()))


def encode_texts(
    docs: DataFrame,
    model_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    decoded: bool = False,
) -> DataFrame:
    """``id, ids`` (an array of integers) of every whole text, one row per input row.

    Null and empty texts give an empty array. With ``decoded`` a column ``text`` has what the
    ids decode to, made in the same pass. Each worker remembers a bounded number of segments,
    and takes slices of bounded text. Map-only; other columns are not read. Null ids and
    repeated rows are kept; an empty table gives no rows.
    """
    model = model_bytes(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in slices(batches, 1, SLICE_ROWS, SLICE_BYTES):
            ids = [encoder.encode(t) for t in texts_as_bytes(batch.column(1))]
            columns = {"id": batch.column(0), "ids": _id_lists(ids)}
            if decoded:
                columns["text"] = pa.array(map(encoder.decode, ids), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids ARRAY<INT>" + (", text STRING" if decoded else "")
    return rows.mapInArrow(run, schema)


def decode_ids(
    encoded: DataFrame, model_path: str, id_column: str = "id", ids_column: str = "ids"
) -> DataFrame:
    """``id, ids, text`` as the library decodes whole lists of ids; null lists give null.

    An empty list gives an empty text, an id that is none of the model's fails. Map-only.
    """
    model = model_bytes(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = _encoder(model).decode
        lists = batch.column(1).to_pylist()
        texts = [None if ids is None else decode(np.array(ids, "<i4")) for ids in lists]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["id", "ids", "text"],
        )

    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch(run), f"id {kind}, ids ARRAY<INT>, text STRING")
