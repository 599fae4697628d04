import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from folioflow.llm import variants

ALPHABET = "abcdeéß÷ñ"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(uses):
    result = {}
    for word, n in uses.items():
        near = [(-m, w) for w, m in uses.items() if one_edit(word, w)]
        less, form = min(near, default=(0, None))
        chosen = form is not None and -less >= 2 * n
        result[word] = [form if chosen else None, n, len(near), -less if chosen else None]
    for word, row in result.items():
        root = word
        while result[root][0] is not None:
            root = result[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in result.items()}


def found_variants(words):
    rows = variants.spelling_variants(words).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def some_words(seed, count):
    chance = random.Random(seed)
    words = {"".join(chance.choices(ALPHABET[:4], k=chance.randint(5, 7))) for _ in range(count)}
    for word in list(words):
        for _ in range(2):
            at, letter = chance.randrange(len(word)), chance.choice(ALPHABET)
            cut = chance.choice([at, at + 1])
            other = word[:at] + chance.choice([letter, ""]) + word[cut:]
            if len(other) >= 5:
                words.add(other)
    long = "".join(chance.choices(ALPHABET, k=3000))
    words |= {long, long[1:], long[:-1], long[:1500] + "z" + long[1501:], long + long, "prefix" + long}
    words |= {"aaaaa" + x for x in ("", "a", "aa", "aaa", "b", "ab")} | {"prefix" + w for w in list(words)[:80]}
    return {w: chance.choice([3, 4, 6, 7, 50, 101]) for w in sorted(words)}


@pytest.mark.parametrize("chunk, letters", [(512, 1 << 20), (8, 1 << 20), (64, 4000)])
def test_variants_match_brute_force(spark, monkeypatch, chunk, letters):
    whole = variants.near_summary
    monkeypatch.setattr(variants, "near_summary", lambda w: whole(w, chunk, letters))
    uses = some_words(chunk, 350)
    words = spark.createDataFrame(list(uses.items()), "word STRING, n BIGINT")
    assert found_variants(words) == brute_variants(uses)


def test_near_words_in_one_block():
    uses = some_words(9, 120)
    for m in (5, 6, 7):
        words = [w for w in uses if len(w) in (m, m + 1)]
        lengths = np.array([len(w) for w in words])
        groups = np.array([hash(w) % 2 for w in words])
        sides = np.array([2 if g else len(w) % 3 % 2 for w, g in zip(words, groups)])
        left, right = variants.near_words(
            variants.letter_codes(words, m + 1), lengths, m, groups, sides
        )
        expected = {
            (a, b)
            for a, x in enumerate(words)
            for b, y in enumerate(words)
            if one_edit(x, y) and min(len(x), len(y)) == m and groups[a] == groups[b]
            and (sides[a] == 2 or sides[a] != sides[b])
        }
        assert len(left) == len(expected) and set(zip(left.tolist(), right.tolist())) == expected


def test_roots_follow_forms_to_the_last(spark):
    uses = {"house": 1000, "housee": 100, "houseee": 10, "hxuseee": 3, "apart": 5}
    found = found_variants(spark.createDataFrame(list(uses.items()), "word STRING, n BIGINT"))
    assert found["hxuseee"] == ("houseee", "house", 3, 1, 10)
    assert found["house"] == (None, "house", 1000, 1, None)
    assert found["apart"] == (None, "apart", 5, 0, None)


def brute_vocabulary(rows):
    uses = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            chance = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if chance % 97 == 0:
                run = run[: chance % len(run)] + run[chance % len(run) + 1 :]
            if len(run) >= 5:
                uses[run] += 1
    return {w: n for w, n in uses.items() if n >= 3}


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_vocabulary_matches_brute_force(spark, documents, held):
    chance = random.Random(2)
    pieces = ["Maison", "élève", "ÉLÈVE", "STRASSE", "straße", "x÷y×zabc", "naïve", "日本naïves", "don't"]
    pieces += ["under_score", "12three45", "abcde", "Ābcdefg", "ﬁnally", "İstanbul", "aaaa", "ñandú"]
    texts = [None, "", " ", "a" * 30_000]
    texts += [chance.choice([" ", ",", "\n"]).join(chance.choices(pieces, k=40)) for _ in range(300)]
    docs = documents(*texts)
    docs = docs.union(docs.limit(40)).union(docs.limit(0))
    docs = docs.unionByName(spark.createDataFrame([(None, "maison élève " * 3, "x", 1)], docs.schema))
    expected = brute_vocabulary([(r.doc_id, r.text) for r in docs.collect()])
    rows = variants.vocabulary(docs, held_words=held).collect()
    assert {r.word: r.n for r in rows} == expected and len(rows) == len(expected)
    assert len(expected) > 20


def test_no_words(spark, documents):
    words = variants.vocabulary(documents("a b").limit(0))
    assert words.count() == 0 and variants.spelling_variants(words).count() == 0
