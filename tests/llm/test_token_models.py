import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from folioflow.llm import common, packing, piece_codec, pieces, token_counts
from tokenizers import Tokenizer

ALPHABET = "aabcehitnou  \n\t▁<s>é😀日本ſﬁ́ .,0123\x00​"


def odd_texts(seed, count):
    chance = random.Random(seed)
    texts = ["", " ", "\n", "▁", "a" * 3000, " " * 500, "<0x0A><s></s><unk>", "ab" * 2000, " "]
    for _ in range(count):
        text = "".join(chance.choices(ALPHABET, k=chance.randint(0, 60)))
        texts.append(text.replace("a", " " * chance.randint(1, 40)) if chance.random() < 0.2 else text)
    return texts


@pytest.fixture(scope="module")
def library(piece_model):
    return sentencepiece.SentencePieceProcessor(model_file=piece_model)


def test_counts_match_the_library(documents, piece_model, library):
    texts = [None, *odd_texts(1, 400)]
    docs = documents(*texts)
    rows = token_counts.count_tokens(docs.union(docs.limit(2)), piece_model, limit=50).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[r.id] or ""
        assert r.n_tokens == len(library.encode(text)), repr(text)
        assert r.n_bytes == len(text.encode())
        assert r.over_limit == (r.n_tokens > 50)
    assert token_counts.count_tokens(docs.limit(0), piece_model).count() == 0


def test_codec_matches_the_library(documents, piece_model, library):
    texts = [None, *odd_texts(2, 400)]
    encoded = piece_codec.encode_texts(documents(*texts), piece_model)
    rows = piece_codec.decode_ids(encoded, piece_model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.id] or "")
        assert r.ids == ids, repr(texts[r.id])
        assert r.text == library.decode(ids)
    assert piece_codec.encode_texts(documents("a").limit(0), piece_model).count() == 0
    both = piece_codec.encode_texts(documents(*texts), piece_model, decoded=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, rows))


def test_lists_of_any_ids_decode_like_the_library(spark, piece_model, library):
    chance = random.Random(7)
    lists = [[], None, [0], [1, 2], [29871], [29871, 29871, 263], [13]]
    lists += [chance.choices(range(0, 400), k=chance.randint(1, 9)) for _ in range(300)]
    lists += [chance.choices(range(259, 32000), k=chance.randint(1, 9)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(lists)), "id INT, ids ARRAY<INT>")
    for r in piece_codec.decode_ids(frame, piece_model).collect():
        expected = None if lists[r.id] is None else library.decode(lists[r.id])
        assert r.text == expected, r.ids


def test_backtracking_equals_merging_for_random_words(piece_model):
    encoder = piece_codec.Encoder(pieces.model_bytes(piece_model))
    chance = random.Random(4)
    known = [p for p in encoder.vocabulary.ids if "▁" not in p]
    for _ in range(3000):
        text = "".join(chance.choices(known, k=chance.randint(1, 6)))
        for stretch in encoder.vocabulary.stretches(text):
            if len(stretch) > 1:
                assert encoder.backtrack(stretch) == encoder.vocabulary.merged(stretch)


def test_other_models_are_refused(word_model):
    with pytest.raises(Exception):
        pieces.Vocabulary(b"no model")


@pytest.mark.parametrize("remembered", [1 << 17, 40])
def test_word_ids_match_the_library(word_model, monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "REMEMBERED_RUNS", remembered)
    chance = random.Random(6)
    safe = ["a", "B", "Σ", "ΑΣ", " ", "\n", "é", "É", "×", "'s", "12", "!?", "日本", "İ", "ß", "\xa0"]
    safe += ["\x00", "😀", "\x1c", "\x85", "\u3000", "don't", "Word.,", "\u0640"]
    odd = ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "J\u030c", "e\u0301", "K\u0328"]
    texts = []
    for parts in (safe, safe + odd):
        texts += ["".join(chance.choices(parts, k=chance.randint(0, 14))) for _ in range(1000)]
    tool = packing.WordTokenizer(open(word_model, "rb").read())
    library = Tokenizer.from_file(word_model)
    for size in (1, 17, 1000):
        for begun in range(0, len(texts), size):
            some = texts[begun : begun + size]
            ids, starts = tool.encode(pa.array(some))
            for text, start, stop in zip(some, starts, starts[1:]):
                expected = library.encode(text, add_special_tokens=False).ids
                assert ids[start:stop].tolist() == expected, repr(text)


def test_keys_in_use_are_not_dropped_with_the_others():
    recent = common.Recent(10)
    for i in range(1000):
        keys = {"hot", i, i + 1}
        fresh = recent.unknown(keys)
        recent.update((k, str(k)) for k in fresh)
        assert all(recent[k] == str(k) for k in keys)
        assert i == 0 or "hot" not in fresh
        assert len(recent) + len(recent.older) <= 2 * (10 + 3)


def test_runs_in_use_stay_in_the_table():
    table, learned = packing.RunTable(10), []

    def learn(runs):
        learned.extend(runs)
        ids = [np.frombuffer(r.encode(), "u1").astype("<u4") for r in runs]
        return np.concatenate(ids), np.array([len(i) for i in ids])

    for i in range(300):
        runs = ["hot", "", f"r{i}", "hot", f"r{i + 1}" * 2]
        places = table.places(pa.array(runs), learn)
        starts = np.cumsum(table.sizes) - table.sizes
        for run, at in zip(runs, places):
            ids = table.ids[starts[at] : starts[at] + table.sizes[at]]
            assert bytes(ids.astype("u1")).decode() == run
        assert len(table.runs) == len(table.sizes) == len(table.used) <= 10 + 6
    assert learned.count("hot") == 1 and "" not in learned


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * n for n in (1, 2, 50, 0, 3, 4, 90, 1)] + [None] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(17)), pa.array(texts)], names=["i", "t"])
    found = list(common.slices([batch, batch.slice(0, 0)], rows=5, size=20))
    assert [s.num_rows for s in found] == [2, 1, 3, 1, 5, 5]
    assert [i for s in found for i in s.column(0).to_pylist()] == list(range(17))


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents_round_trip(documents, word_model):
    chance = random.Random(8)
    texts = [None, "", "same words here"] + ["same words here"] * 700
    texts += [" ".join(["word"] * chance.randint(0, 150)) for _ in range(400)] + ["x y " * 500]
    found = packing.token_pieces(documents(*texts), word_model, capacity=100)
    rows = packing.pack(found, capacity=100).collect()
    library = Tokenizer.from_file(word_model)
    whole = {}
    for r in sorted(rows, key=lambda r: (r.id, r.piece)):
        assert r.start == 100 * r.piece and len(r.ids) == 4 * r.length
        whole[r.id] = whole.get(r.id, b"") + bytes(r.ids)
    for i, text in enumerate(texts):
        expected = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(whole[i], "<u4").tolist() == expected
    tokens = sum(r.length for r in rows)
    assert check_layout(rows, 100) <= -(-tokens // 100) + 2
    assert packing.pack(found.limit(0), capacity=100).count() == 0


def test_repeated_rows_and_bad_lengths(spark):
    frame = spark.createDataFrame([(1, 60), (1, 60), (None, 40), (2, 100)], "k INT, length BIGINT")
    rows = packing.pack(frame, capacity=100).collect()
    assert len(rows) == 4 and check_layout(rows, 100) == 3
    for bad in (0, 101, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "k INT, length BIGINT"), capacity=100)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_close_to_the_bound(seed):
    chance = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    for length in chance.integers(1, 257, size=chance.integers(1, 200)):
        counts[length] += chance.integers(1, 3000)
    layout = packing.plan(counts)
    placed = np.zeros_like(counts)
    used = {}
    for length, first, last, sequence, each, offset in layout.runs:
        placed[length] += last - first
        for k in range(last - first):
            fill = used.setdefault(sequence + k // each, [])
            fill.append((offset + k % each * length, length))
    assert (placed == counts).all() and len(used) == layout.sequences
    for fill in used.values():
        at = 0
        for offset, length in sorted(fill):
            assert offset == at
            at += length
        assert at <= 256
    best_fit = packing.Layout(counts)
    best_fit.best_fit()
    assert layout.sequences <= 1.02 * best_fit.sequences + 2


def test_fractional_patterns_cover_the_demand():
    sizes, demand = np.array([70, 45, 30]), np.array([10.0, 20.0, 40.0])
    found = packing.fractional_patterns(sizes, demand, 100)
    covered = sum(p * use for p, use in found)
    assert np.allclose(covered, demand)
    assert all(p @ sizes <= 100 for p, _ in found)
    # 70+30, 45+45, 30+30+30: ten, ten and ten sequences.
    assert abs(sum(use for _, use in found) - 30) < 1e-6


def test_checksum_of_ids(spark, documents, word_model):
    rows = packing.token_pieces(documents("hello"), word_model).selectExpr("ids", "crc32(ids) c")
    row = rows.first()
    assert row.c == zlib.crc32(bytes(row.ids)) and hashlib.sha1(bytes(row.ids)).digest()
