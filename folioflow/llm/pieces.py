"""The vocabulary of a merge-type sentencepiece model and the texts' natural segments."""

from __future__ import annotations

import heapq
import re
from pathlib import Path

import numpy as np
import sentencepiece

SPACE = "▁"
# Stretches that no piece crosses: spaces lead a word, a line break stands alone.
SEGMENT = re.compile(rb" *[^ \n]+|\n| +")


class Vocabulary:
    """Pieces with their merge order, and byte pieces for what the vocabulary lacks.

    Made for models that merge pairs by score, take texts as they are but for spaces, put a
    space before the first word, and have byte pieces; others are refused.
    """

    def __init__(self, model: bytes):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.ids, scores, self.bytes = {}, {}, {}
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i)):
                self.ids[piece] = i
                scores[piece] = library.get_score(i)
        self.check(scores)
        # What whole pieces decode to; the others are the library's to decode.
        self.whole = np.zeros(size, dtype=bool)
        self.whole[list(self.ids.values())] = True
        self.texts = [b""] * size
        for piece, i in self.ids.items():
            self.texts[i] = piece.replace(SPACE, " ").encode()
        # Equal scores share a rank; the pair further left then merges first.
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items() if len(p) > 1}
        self.pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}

    def check(self, scores: dict[str, float]) -> None:
        if len(self.bytes) != 256 or SPACE not in self.ids or "\n" in self.ids:
            raise ValueError("the model lacks byte pieces, or has one for the line break")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in scores):
            raise ValueError("the model has pieces that cross words")
        probe = " a  ﬁ "
        if self.library.decode(self.library.encode(probe)) != probe:
            raise ValueError("the model rewrites texts before it cuts them")

    def stretches(self, text: str) -> list[str]:
        """``text`` cut between characters that follow each other in no piece."""
        pairs, begun, found = self.pairs, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                found.append(text[begun:i])
                begun = i
        found.append(text[begun:])
        return found

    def merged(self, text: str) -> list[str]:
        """What is left of the characters once no adjacent pair can merge.

        A heap holds the pairs by rank and place; a doubly linked list holds what is left. An
        entry is stale when one of its sides is gone or has grown.
        """
        ranks, size = self.ranks, len(text)
        parts: list[str] = list(text)
        onward, back = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            pair = text[i : i + 2]
            if pair in ranks:
                heap.append((ranks[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = onward[i]
            if not parts[i] or j == size or len(parts[i]) + len(parts[j]) != len(pair):
                continue
            parts[i], parts[j] = pair, ""
            k = onward[i] = onward[j]
            if k < size:
                back[k] = i
                wider = pair + parts[k]
                if wider in ranks:
                    heapq.heappush(heap, (ranks[wider], i, wider))
            h = back[i]
            if h >= 0:
                wider = parts[h] + pair
                if wider in ranks:
                    heapq.heappush(heap, (ranks[wider], h, wider))
        return [p for p in parts if p]

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """The id of a piece, or those of its bytes."""
        if piece in self.ids:
            return (self.ids[piece],)
        return tuple(self.bytes[b] for b in piece.encode())


def segments(text: bytes | None) -> list[bytes]:
    """The segments of a text, with the space that the model puts before it."""
    if not text:
        return []
    return SEGMENT.findall(b" " + text.replace(SPACE.encode(), b" "))


def as_pieces(segment: bytes) -> str:
    return segment.decode(errors="replace").replace(" ", SPACE)


def model_bytes(path: str) -> bytes:
    """The model file, read once where the plan is made and sent with the tasks."""
    return Path(path).read_bytes()
