"""Each query of the subpackage over whole small tables, against a direct re-statement."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import sentencepiece
import xxhash
from folioflow.llm import language, licences, queries, simhash
from folioflow.llm.licence_digests import TEXT_DIGESTS
from tokenizers import Tokenizer

from test_audit import brute_audit
from test_chat import expected as expected_digests
from test_simhash import brute_components
from test_token_models import check_layout
from test_variants import brute_variants, brute_vocabulary
from test_vectors_warc import brute_links

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


def rows_of(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in rows_of("documents")}


def run(spark, name, columns):
    """The rows of a query by their first column, whose names and types must be as said."""
    frame = queries.QUERIES[name](spark, SMALL)
    kinds = dict(c.split() for c in columns.split(", "))
    found = dict(frame.dtypes)
    assert {c: found.get(c) for c in kinds} == kinds
    return frame.collect()


def held_out(ident, modulus, remainder):
    return zlib.crc32(str(ident).encode()) % modulus == remainder


def canonical_lines(text):
    plain = text.replace("©", " copyright ").lower()
    plain = regex.sub(r"[^\p{L}\p{N}\n]+", " ", plain)
    lines = []
    for line in plain.split("\n"):
        words = " " + " ".join(line.split(" ")) + " "
        words = " " + " ".join(w for w in words.split(" ") if w) + " "
        line = respelled(words).strip()
        own = re.search(licences.COPYRIGHT_LINE, line) and not re.search(licences.COPYRIGHT_TERMS, line)
        if line and not own:
            lines.append(line)
    return lines


def respelled(words):
    for other, chosen in licences.SPELLINGS:
        words = words.replace(f" {other} ", f" {chosen} ")
    return words


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole_digest(lines):
    return sha256(respelled(" " + " ".join(lines) + " ").strip()) if lines else None


def test_op1_licences(spark, documents):
    known = {}
    for name, texts in licences.LICENCES.items():
        for text in texts:
            known.setdefault(whole_digest(canonical_lines(text)), []).append(name)
    for name, digests in TEXT_DIGESTS.items():
        for d in digests:
            known.setdefault(d, []).append(name)
    rows = run(spark, "op1_licences", "doc_id bigint, license_id string, notices string, n_notices bigint")
    assert len(rows) == len(documents)
    for r in rows:
        lines = canonical_lines(documents[r.doc_id]["text"] or "")
        found = [min(known[d]) for d in map(sha256, lines) if d in known]
        digest = whole_digest(lines)
        assert r.digest == digest
        assert r.license_id == (min(known[digest]) if digest in known else None)
        assert (r.notices, r.n_notices) == (",".join(sorted(set(found))), len(found))


def test_op2_warc(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in rows_of("pages")}
    largest = {}
    for ident, payload in pages.items():
        largest[payload] = max(ident, largest.get(payload, ident))
    rows = run(
        spark, "op2_warc",
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        payload = pages[r.page_id]
        again = len(payload) >= 1000 and largest[payload] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.record_type == ("revisit" if again else "response")
        assert r.refers_to == (largest[payload] if again else None)


def test_op3_quality(spark, documents):
    rows = run(spark, "op3_quality", "doc_id bigint, held_out boolean, score double, predicted int")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    labels = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    right = []
    for r in rows:
        assert r.held_out == held_out(r.doc_id, 3, 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and labels.get(r.doc_id) is not None:
            right.append(r.predicted == labels[r.doc_id])
    assert len(right) >= 10 and sum(right) >= 0.9 * len(right)


def test_op4_vectors(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in rows_of("embeddings")]
    edges = brute_links(rows)
    links = Counter(i for e in edges for i in e)
    found = run(spark, "op4_vectors", "vec_id bigint, n_links bigint, component_id bigint, kept boolean")
    ids = [r[0] for r in rows]
    roots = brute_components(ids, [(ids[a], ids[b]) for a, b in edges])
    assert len(found) == len(rows)
    for r in found:
        assert r.n_links == links[ids.index(r.vec_id)]
        assert r.component_id == roots[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        value = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += value >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_op5_simhash(spark, documents):
    prints = {i: fingerprint(r["text"]) for i, r in documents.items()}
    ids = sorted(prints)
    edges = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = brute_components(ids, edges)
    rows = run(spark, "op5_simhash", "doc_id bigint, fingerprint string, component_id bigint")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", roots[i]) for i in ids
    }


def test_op6_language(spark, documents):
    rows = run(spark, "op6_language", "doc_id bigint, held_out boolean, lang_pred string, score double")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    learned = {r["lang"] for i, r in documents.items() if r["lang"] and not held_out(i, 5, 0)}
    right = []
    for r in rows:
        doc = documents[r.doc_id]
        assert r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, doc["text"] or "")):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in learned
            right += [r.lang_pred == doc["lang"]] if r.held_out and doc["lang"] else []
    assert len(right) >= 20 and sum(right) >= 0.95 * len(right)


def test_op7_packing(spark, documents):
    rows = run(
        spark, "op7_packing",
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint,"
        " offset bigint",
    )
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {(r.doc_id, r.piece): r for r in rows}
    total, expected = 0, set()
    for i, doc in documents.items():
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            some, r = ids[at : at + 4096], pieces[i, k]
            expected.add((i, k))
            assert (r.start, r.length) == (at, len(some))
            assert r.ids_crc32 == zlib.crc32(np.array(some, dtype="<u4").tobytes())
    assert set(pieces) == expected and len(rows) == len(expected)
    assert check_layout(rows, 4096) <= math.ceil(total / 4096) + 2


def test_op8_rules(spark, documents):
    rows = run(
        spark, "op8_rules",
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, kept boolean",
    )
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id]["text"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = set()
        for i in range(len(words) - 7):
            if windows[tuple(words[i : i + 8])] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert (r.n_repeat_words, r.base_failed) == (len(covered), failed)
        assert not (r.kept and failed)
    labels = {r["doc_id"]: r["quality"] for r in rows_of("labels")}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_op9_tokens(spark, documents, pieces):
    rows = run(spark, "op9_tokens", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r.doc_id]["text"] or ""
        count = len(pieces.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), count, count > 4096)


def test_op10_pieces(spark, documents, pieces):
    rows = run(spark, "op10_pieces", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        ids = pieces.encode(documents[r.doc_id]["text"] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)))
        assert r.decoded_sha256 == sha256(pieces.decode(ids))


def test_op11_chat(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of("conversations")]
    said = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows = run(
        spark, "op11_chat",
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint",
    )
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == (
        expected_digests(turns)
    )
    own = next(r for r in rows if r.conv_id == -7)
    whole = "[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"
    assert own.formatted_chars == len(whole) and own.loss_chars == len(said)


def test_op12_audit(spark, documents):
    docs = [(i, r["text"], r["lang"]) for i, r in documents.items()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in rows_of("labels")]
    rows = run(
        spark, "op12_audit",
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint,"
        " unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    )
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert found == brute_audit(docs, labels) and len(rows) == len(found)


def test_op13_variants(spark, documents):
    uses = brute_vocabulary([(i, r["text"]) for i, r in documents.items()])
    rows = run(
        spark, "op13_variants",
        "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    )
    # The re-statement compares all words with all, so words that differ much in length or
    # letters are passed over first.
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert {w: f[2] for w, f in found.items()} == uses and len(rows) == len(uses)
    by_cut = {}
    for word in uses:
        for key in {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}:
            by_cut.setdefault(key, set()).add(word)
    near = {w: set() for w in uses}
    for group in by_cut.values():
        for a in group:
            near[a] |= group - {a}
    for word in list(uses)[:300]:
        some = {w: uses[w] for w in near[word] | {word}}
        form, _, n, count, form_n = brute_variants(some)[word]
        assert found[word][:1] + found[word][2:] == (form, n, count, form_n)
    for word, (form, root, *_) in found.items():
        assert root == (word if form is None else found[form][1])


def test_very_long_texts(spark):
    chance = random.Random(3)
    known = ["".join(chance.choices("abcdeéGH", k=chance.randint(1, 8))) for _ in range(5000)]
    texts = [" ".join(chance.choices(known, k=200_000)) + "\nReleased under the MIT License."]
    texts += ["x" * 1_500_000, "Copyright 1\n" * 100_000, texts[0].replace("a", "é")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    for r in licences.scan_licences(docs).collect():
        assert r.digest == whole_digest(canonical_lines(texts[r.id]))
        assert r.notices == (["MIT"] if r.id in (0,) else [])
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint % (1 << 64) == fingerprint(texts[r.id])
    learned = {"one": language.letters(texts[0][:30_000]), "two": b"xyz " * 2000}
    found = {r.doc_id: r.lang_pred for r in language.detect_language(docs, learned).collect()}
    assert found[0] == "one" and set(found.values()) <= {"one", "two"}


def test_queries_over_empty_tables(spark, tmp_path):
    for name in TABLES:
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        frame = query(spark, str(tmp_path))
        assert frame.count() == (name == "op11_chat"), name
