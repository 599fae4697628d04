import hashlib
import random
from itertools import groupby

import pytest
from folioflow.llm import chat
from pyspark.sql import functions as F

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, id STRING, loss STRING"
PARTS = f"conv_id BIGINT, turn BIGINT, role STRING, parts ARRAY<{chat.PART}>"


def as_turns(spark, rows):
    made = [(c, t, r, x, "x", "y") for c, t, r, x in rows]
    return spark.createDataFrame(made, TURNS).withColumn("parts", chat.text_part(F.col("text")))


def expected(rows):
    """By conversation: turns, digest, learned characters and their digest."""
    order = sorted(
        ((c, t, r or "", x or "") for c, t, r, x in rows),
        key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3]),
    )
    result = {}
    for ident, some in groupby(order, key=lambda x: x[0]):
        some = list(some)
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in some)
        learned = "".join(x for _, _, r, x in some if r == "assistant")
        result[ident] = (
            len(some), hashlib.sha256(whole.encode()).hexdigest(),
            len(learned), hashlib.sha256(learned.encode()).hexdigest(),
        )
    return result


def digests(segments):
    rows = chat.conversation_digests(chat.stored_segments(segments)).collect()
    found = {r.id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_text(chance):
    parts = [*chat.CONTROL, "\\", "[", "<", "]", "a b", "é", "😀", "\n", "<\\s>", "[\\\\INST]", "s>"]
    return "".join(chance.choices(parts, k=chance.randint(0, 8)))


@pytest.mark.parametrize("turns, chars", [(1024, 1 << 20), (3, 1 << 20), (1024, 40)])
def test_conversations_come_back_from_their_text(spark, turns, chars):
    chance = random.Random(turns + chars)
    roles = ["user", "assistant", "system", "tool [END]", "", None, "[ROLE]"]
    rows = []
    for conv in range(60):
        for turn in range(chance.randint(1, 9)):
            rows.append((conv, turn, chance.choice(roles), odd_text(chance)))
    rows += [(7, 100 + t, "assistant", odd_text(chance)) for t in range(400)]  # a hot one
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", None), (70, None, "user", "")]
    rows += [(71, 5, "user", "same")] * 9 + [(72, 1, "assistant", "x" * 200_000)]
    rows += [(73, 1, "b", "z"), (73, 1, "a", "y")]
    segments = chat.format_conversations(
        as_turns(spark, rows), segment_turns=turns, segment_chars=chars
    )
    assert digests(segments) == expected(rows)
    parts = segments.collect()
    assert all(r.n_turns <= turns for r in parts)
    assert any(r.alone for r in parts) and sum(r.id == 7 for r in parts) > (turns < 1000)


def test_escaping_is_reversible_and_leaves_no_control_string(evaluate_text):
    chance = random.Random(5)
    texts = list({odd_text(chance) for _ in range(3000)})
    escaped = evaluate_text(chat.escaped(F.col("text")), *texts)
    assert len(set(escaped)) == len(texts)
    for text, safe in zip(texts, escaped):
        assert chat.unescaped(safe) == text
        assert not any(c in safe for c in chat.CONTROL)
        for before, after in (chat.ASKED, chat.ANSWERED):
            whole = before + safe + after
            assert sum(whole.count(c) for c in chat.CONTROL) == 2


def test_template_and_loss_mask(spark):
    rows = [(1, 0, "system", "be [END] kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s> é")]
    (segment,) = chat.format_conversations(as_turns(spark, rows)).collect()
    assert segment.text == "[ROLE]system[/ROLE]be [\\END] kind[END][INST]hi[/INST]<s><\\/s> é</s>"
    ((start, length),) = segment.loss
    assert segment.text[start : start + length] == "<\\/s> é"
    assert list(chat.read_turns(segment.text)) == [
        ("system", "be [\\END] kind"), ("user", "hi"), ("assistant", "<\\/s> é")
    ]
    with pytest.raises(ValueError):
        list(chat.read_turns("text without a turn"))


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts_become_placeholders_in_order(spark):
    first = [
        part("text", "see [IMG] "), part("image", ref="a.png", width=57, height=28),
        part("audio", ref="b.wav", seconds=2.5), part("text", None), part("document", ref="c", pages=3),
        part("image", ref="d.png"), part("video", "as text", "e"), part(None, "!"),
    ]
    rows = [(1, 0, "user", first), (1, 1, "assistant", [part("image", ref="f", width=28, height=28)])]
    rows += [(1, 2, "user", []), (1, 3, "assistant", None)]
    turns = spark.createDataFrame(rows, PARTS)
    (segment,) = chat.format_conversations(turns).collect()
    assert segment.text == (
        "[INST]see [\\IMG] [IMG][AUDIO][DOC][IMG]as text![/INST]<s>[IMG]</s>[INST][/INST]<s></s>"
    )
    found = [(a.kind, a.ref, a.tokens) for a in segment.attachments]
    assert found == [
        ("image", "a.png", 3), ("audio", "b.wav", 32), ("document", "c", 3072),
        ("image", "d.png", 1), ("image", "f", 1),
    ]
    smaller = chat.PartVisitor(patch=14, tokens_a_second=1, tokens_a_page=10)
    (segment,) = chat.format_conversations(turns, visitor=smaller).collect()
    assert [a.tokens for a in segment.attachments] == [10, 3, 30, 1, 4]
    segments = chat.stored_segments(chat.format_conversations(turns))
    (row,) = chat.conversation_digests(segments).collect()
    assert (row.attachment_tokens, row.n_turns) == (3 + 32 + 3072 + 1 + 1, 4)
    assert row.formatted_chars == len(
        "[INST]see [\\IMG] [IMG][AUDIO][DOC][IMG]as text![/INST]<s>[IMG]</s>[INST][/INST]<s></s>"
    )


def test_no_conversations(spark):
    segments = chat.format_conversations(as_turns(spark, [(1, 1, "user", "x")]).limit(0))
    assert digests(segments) == {}
