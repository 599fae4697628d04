"""Conversations of typed content parts as training text, with loss spans and attachments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import scratch_path

from .common import slices

# The control strings of the template. Each opens with "<" or "[" and holds
# neither anywhere else, so none can arise where two texts meet.
ASKED, ANSWERED, NAMED = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[ROLE]", "[END]")
NAME_END = "[/ROLE]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = (*ASKED, *ANSWERED, *NAMED, NAME_END, *PLACEHOLDERS.values())

LEARNED_ROLE = "assistant"
ASKING_ROLE = "user"

# Turns and characters of a segment, beyond which another begins.
SEGMENT_TURNS = 1024
SEGMENT_CHARS = 1 << 20

PART = (
    "STRUCT<kind: STRING, text: STRING, ref: STRING, width: INT, height: INT,"
    " seconds: DOUBLE, pages: INT>"
)
ATTACHMENTS = "ARRAY<STRUCT<kind: STRING, ref: STRING, tokens: BIGINT>>"
SEGMENTS = (
    " partition INT, place BIGINT, alone BOOLEAN, text STRING, n_turns BIGINT,"
    f" loss ARRAY<STRUCT<start: BIGINT, length: BIGINT>>, attachments {ATTACHMENTS}"
)

_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(?=\\*(?:{_TAILS}))"
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_TAILS}))")


def escaped(text: Column) -> Column:
    """``text`` with a backslash put inside whatever reads like a control string.

    Such a string with backslashes inside already gets one more, so that ``unescaped`` undoes
    just this and no two texts become the same.
    """
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass(frozen=True)
class PartVisitor:
    """Flattens content parts: one method per kind, chosen by the part's kind.

    Each method gives ``text`` (escaped text, or the kind's placeholder) and ``attachment``
    (null for text): the reference and the number of tokens that the placeholder expands to
    once the model sees the attachment. A part of another kind, or of none, is read as text;
    missing text is empty, and missing sizes count as one patch, no seconds and one page.
    """

    patch: int = 28
    tokens_a_second: float = 12.5
    tokens_a_page: int = 1024

    def visit_text(self, part: Column) -> Column:
        none = F.lit(None).cast(ATTACHMENTS[6:-1])
        return self._flat(escaped(F.coalesce(part["text"], F.lit(""))), none)

    def visit_image(self, part: Column) -> Column:
        def patches(side: str) -> Column:
            return F.greatest(F.ceil(F.coalesce(part[side], F.lit(1)) / self.patch), F.lit(1))

        return self._attached("image", part, patches("width") * patches("height"))

    def visit_audio(self, part: Column) -> Column:
        seconds = F.coalesce(part["seconds"], F.lit(0.0))
        return self._attached("audio", part, F.ceil(seconds * self.tokens_a_second))

    def visit_document(self, part: Column) -> Column:
        return self._attached(
            "document", part, F.coalesce(part["pages"], F.lit(1)) * self.tokens_a_page
        )

    def visit(self, part: Column) -> Column:
        chosen = self.visit_text(part)
        for kind in PLACEHOLDERS:
            chosen = F.when(
                part["kind"] == kind, getattr(self, f"visit_{kind}")(part)
            ).otherwise(chosen)
        return chosen

    def _attached(self, kind: str, part: Column, tokens: Column) -> Column:
        attachment = F.struct(
            F.lit(kind).alias("kind"),
            part["ref"].alias("ref"),
            F.greatest(tokens, F.lit(0)).cast("bigint").alias("tokens"),
        )
        return self._flat(F.lit(PLACEHOLDERS[kind]), attachment)

    @staticmethod
    def _flat(text: Column, attachment: Column) -> Column:
        return F.struct(text.alias("text"), attachment.alias("attachment"))


def text_part(text: Column) -> Column:
    """A plain text as the only part of a turn."""
    fields = [F.lit("text").alias("kind"), text.alias("text")]
    others = (
        ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"),
        ("pages", "int"),
    )
    fields += [F.lit(None).cast(kind).alias(name) for name, kind in others]
    return F.array(F.struct(*fields))


def formatted_turn(role: Column, parts: Column, visitor: PartVisitor) -> Column:
    """``text, loss_start, loss_length, attachments`` of a turn, places in code points."""
    flat = F.transform(F.coalesce(parts, F.array().cast(f"ARRAY<{PART}>")), visitor.visit)
    body = F.array_join(F.transform(flat, lambda p: p["text"]), "")
    attachments = F.filter(
        F.transform(flat, lambda p: p["attachment"]), lambda a: a.isNotNull()
    )
    name = F.concat(F.lit(NAMED[0]), escaped(role), F.lit(NAME_END))
    learned, asking = role == LEARNED_ROLE, role == ASKING_ROLE
    opening = F.when(learned, ANSWERED[0]).when(asking, ASKED[0]).otherwise(name)
    closing = F.when(learned, ANSWERED[1]).when(asking, ASKED[1]).otherwise(NAMED[1])
    return F.struct(
        F.concat(opening, body, closing).alias("text"),
        F.when(learned, F.lit(len(ANSWERED[0]))).cast("bigint").alias("loss_start"),
        F.when(learned, F.length(body)).cast("bigint").alias("loss_length"),
        attachments.alias("attachments"),
    )


def _segments(turns: int, chars: int):
    """Rows in order to segments: the runs of one conversation, cut where they are long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        kinds = None
        done: list[tuple] = []
        held: list[str] = []
        loss, attachments, size, count, place, waiting = [], [], 0, 0, 0, 0
        first, cut, conversation = True, False, None

        def close(ended: bool) -> None:
            nonlocal held, loss, attachments, size, count, place, cut, waiting
            alone = ended and not first and not cut
            done.append(
                (conversation, partition, place, alone, "".join(held), count, loss, attachments)
            )
            waiting += size
            held, loss, attachments, size, count = [], [], [], 0, 0
            place, cut = place + 1, not ended

        def flushed() -> pa.RecordBatch:
            nonlocal done, waiting
            columns = [pa.array(list(c), k.type) for c, k in zip(zip(*done), kinds)]
            done, waiting = [], 0
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        for batch in slices(batches, 1):
            kinds = kinds or pa.schema(
                [
                    ("id", batch.schema.field(0).type),
                    ("partition", pa.int32()),
                    ("place", pa.int64()),
                    ("alone", pa.bool_()),
                    ("text", pa.string()),
                    ("n_turns", pa.int64()),
                    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    ("attachments", batch.schema.field(4).type),
                ]
            )
            for ident, text, start, length, attached in zip(
                *(batch.column(i).to_pylist() for i in range(5))
            ):
                if count and ident != conversation:
                    close(True)
                    first = False
                elif count >= turns or size >= chars:
                    close(False)
                elif cut and ident != conversation:
                    cut = first = False
                conversation = ident
                if start is not None:
                    loss.append({"start": size + start, "length": length})
                attachments += attached
                held.append(text)
                size += len(text)
                count += 1
                if len(done) >= turns or waiting >= 8 * chars:
                    yield flushed()
        # The last conversation may go on in the next partition.
        if count:
            close(False)
        if done:
            yield flushed()

    return run


def format_conversations(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    parts_column: str = "parts",
    visitor: PartVisitor = PartVisitor(),
    segment_turns: int = SEGMENT_TURNS,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Formatted conversations in segments of whole turns: ``id`` and the columns of SEGMENTS.

    ``parts_column`` is an array of PART, a null array being no parts. Turns go by number
    (nulls first), then role, then a hash of their parts; repeated rows are turns of their own.
    A null role is an empty one; rows with a null id are one conversation. ``loss`` marks the
    texts of the assistant by start and length in code points of the segment, and
    ``attachments`` lists what the segment's placeholders stand for, in their order. An empty
    table gives no rows; other columns are not read.

    One range shuffle by conversation and turn, so that a conversation of any length is spread
    over many tasks; each makes segments of at most ``segment_turns`` turns, or of fewer once
    they pass ``segment_chars``. ``partition, place`` order the segments of a conversation, and
    ``alone`` says that a segment is known to be all of it. Formatting uses expressions only;
    rows are joined to segments in Arrow tasks.
    """
    rows = turns.select(
        F.col(id_column).alias("id"),
        F.col(turn_column).alias("_turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("_role"),
        F.col(parts_column).alias("_parts"),
    ).withColumn("_tie", F.xxhash64("_parts"))
    order = ["id", "_turn", "_role", "_tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    formatted = placed.select(
        "id", formatted_turn(F.col("_role"), F.col("_parts"), visitor).alias("_made")
    ).select("id", "_made.*")
    kind = rows.schema["id"].dataType.simpleString()
    return formatted.mapInArrow(
        _segments(segment_turns, segment_chars), f"id {kind},{SEGMENTS}"
    )


def stored_segments(segments: DataFrame) -> DataFrame:
    """Segments written to the shared folder, apart by ``alone``, and read back."""
    path = scratch_path(segments.sparkSession, "chat-segments")
    segments.write.partitionBy("alone").parquet(path)
    return segments.sparkSession.read.schema(segments.schema).parquet(path)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and body of each turn of a formatted text; bodies are as formatted."""
    at = 0
    while at < len(text):
        for role, (opening, closing) in ((ASKING_ROLE, ASKED), (LEARNED_ROLE, ANSWERED), ("", NAMED)):
            if text.startswith(opening, at):
                break
        else:
            raise ValueError("a turn opens with no control string")
        begun = at + len(opening)
        if not role:
            stop = text.index(NAME_END, begun)
            role, begun = unescaped(text[begun:stop]), stop + len(NAME_END)
        stop = text.index(closing, begun)
        yield role, text[begun:stop]
        at = stop + len(closing)


DIGESTS = (
    "n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING,"
    " formatted_chars BIGINT, attachment_tokens BIGINT"
)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to one row per conversation, holding one segment at a time."""
    state, rows, kind = None, [], None

    def finished() -> tuple:
        ident, turns, learned, *counts = state
        return (
            ident, counts[0], turns.hexdigest(), counts[1], learned.hexdigest(), *counts[2:]
        )

    def flushed() -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["id", *(c.split()[0] for c in DIGESTS.split(", "))]
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in slices(batches, 1, 256):
        kind = batch.schema.field(0).type
        for ident, text, loss, attachments in zip(
            *(batch.column(i).to_pylist() for i in range(4))
        ):
            if state is None or state[0] != ident:
                if state is not None:
                    rows.append(finished())
                state = [ident, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
            for role, body in read_turns(text):
                state[1].update(f"{role}\n{unescaped(body)}\n".encode())
                state[3] += 1
            for span in loss:
                plain = unescaped(text[span["start"] : span["start"] + span["length"]])
                state[2].update(plain.encode())
                state[4] += len(plain)
            state[5] += len(text)
            state[6] += sum(a["tokens"] for a in attachments)
        if len(rows) >= 1000:
            yield flushed()
    if state is not None:
        rows.append(finished())
    if rows:
        yield flushed()


def conversation_digests(segments: DataFrame) -> DataFrame:
    """``id`` and the columns of DIGESTS per conversation, read back from formatted text.

    ``turns_sha256`` is over the role, a line break, the text and a line break of each turn;
    ``loss_sha256`` over the texts under the loss mask, both unescaped and in order.
    Placeholders stand in the texts as they are. Give it ``stored_segments``.

    Segments that are all of a conversation are digested where they lie; only conversations
    at the edges of the range partitions are shuffled. SHA-256 takes bytes one after another,
    so all segments of one conversation pass through one task, which holds one at a time.
    """
    columns = ["id", "text", "loss", "attachments"]
    kind = segments.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {DIGESTS}"
    whole = segments.filter("alone").select(*columns).mapInArrow(_digest, schema)
    parted = (
        segments.filter("NOT alone")
        .repartition("id")
        .sortWithinPartitions("id", "partition", "place")
        .select(*columns)
        .mapInArrow(_digest, schema)
    )
    return whole.union(parted)
