import collections
import math
import random
import textwrap
import zlib

import numpy as np
import pytest
from folioflow.llm import discriminant, language, licences, rules
from folioflow.llm.common import bucket_of
from pyspark.sql import functions as F

WHITE = " \t\n\v\f\r"


def words_of(text):
    found, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            if word:
                found.append(word)
            word = ""
        else:
            word += c
    return found


def prose(seed, count, vocabulary=200):
    chance = random.Random(seed)
    known = ["".join(chance.choices("abcdeéfg", k=chance.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(chance.choices(known, k=count))


def test_rule_counts_match_brute_force(documents):
    chance = random.Random(1)
    texts = [None, "", " \n ", "a b", " leading", "é x #*$", "same\nsame\n\n \nsame", "x " * 40]
    phrase = "one two three four five six seven eight nine"
    texts += [f"{phrase} and {phrase} " + prose(2, 50), prose(3, 500) + "\n" + prose(3, 12)]
    for _ in range(60):
        lines = [prose(chance.randint(1, 9), chance.randint(0, 14), 12) for _ in range(12)]
        texts.append("\n".join(chance.choices(lines, k=chance.randint(1, 15))))
    docs = documents(*texts)
    ratios = np.zeros(rules.BUCKETS)
    rows = rules.quality_rules(docs.union(docs.limit(1)), ratios).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.doc_id] or ""
        words = words_of(text)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = set()
        for i in range(len(words) - 7):
            if windows[tuple(words[i : i + 8])] > 1:
                covered |= set(range(i, i + 8))
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))
        assert r.n_repeat_words == len(covered)
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_pulled_ratios_match_brute_force(spark, documents):
    texts = [None, "", *[prose(s, 40) for s in range(20)]]
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(2, 14)] + [(4, 0), (None, 1), (5, None), (99, 1), (7, 1)],
        "doc_id BIGINT, quality INT",
    )
    trusted = rules.trusted_documents(labels)
    good = {2, 5, 7, 8, 10, 11, 13}
    assert {r[0] for r in trusted.collect()} == good | {99}
    got = rules.pulled_ratios(documents(*texts), trusted, buckets=64, pull=50.0)
    raw, target = collections.Counter(), collections.Counter()
    for i, text in enumerate(texts):
        hashes = [rules.word_hash(w.encode()) for w in words_of(text)]
        grams = [h % 64 for h in hashes]
        grams += [(a * 31 + b) % 64 for a, b in zip(hashes, hashes[1:])]
        raw.update(grams)
        if i in good:
            target.update(grams)
    for b in range(64):
        share = (raw[b] + 1) / (sum(raw.values()) + 64)
        pulled = (target[b] + 50 * share) / (sum(target.values()) + 50)
        assert got[b] == pytest.approx(math.log(pulled / share))
    none = rules.pulled_ratios(documents("a").limit(0), trusted, buckets=64)
    assert none.tolist() == [0.0] * 64


def test_few_or_no_trusted_texts_lose_no_clean_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = rules.trusted_documents(labels)
    ids = sorted(r[0] for r in good.collect())
    for size in (0, 1, 10, 80):
        trusted = good.filter(F.col("_trusted").isin(ids[:size])) if size else good.limit(0)
        ratios = rules.pulled_ratios(docs, trusted)
        judged = rules.quality_rules(docs.join(good, F.col("doc_id") == F.col("_trusted")), ratios)
        passed = judged.filter("NOT base_failed").select("kept").collect()
        assert len(passed) > 300 and sum(r.kept for r in passed) >= 0.99 * len(passed), size
        if not size:
            assert not ratios.any()


def test_log_ratio_decides(documents):
    clean, junk = prose(1, 60), prose(2, 60, 30).replace("a", "|")
    ratios = np.zeros(rules.BUCKETS)
    ratios[np.unique(rules.ngram_buckets([w.encode() for w in junk.split()], rules.BUCKETS))] = -1
    kept = {r.doc_id: r.kept for r in rules.quality_rules(documents(clean, junk), ratios).collect()}
    assert kept == {0: True, 1: False}


LANGUAGES = {"xx": "kolu meta rino sava", "yy": "brelk stort gnarf plimp", "zz": "aeio oua iue eea"}


def language_texts(seed, count):
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        lang = chance.choice(list(LANGUAGES))
        parts = LANGUAGES[lang].split()
        words = ["".join(chance.choices(parts, k=2)) for _ in range(chance.randint(15, 60))]
        rows.append((i, " ".join(words) + ".", lang))
    return rows


def test_languages_are_told_apart(spark):
    rows = language_texts(1, 200)
    learned = spark.createDataFrame(
        rows + [(900, None, "xx"), (901, "a b", None), (902, "", "yy"), (None, "q", "xx")]
        + [(i, "copy of one text", "xx") for i in range(1000, 1200)],
        "doc_id BIGINT, text STRING, lang STRING",
    )
    dictionaries = language.learn_dictionaries(learned)
    assert list(dictionaries) == ["xx", "yy", "zz"]
    assert dictionaries["xx"].count(b"copy of one text") <= 1
    assert all(len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())
    test = language_texts(2, 100)
    texts = [(i, t, "no", 1.5) for i, t, _ in test]
    odd = [(500, None), (501, ""), (502, "12 !? \n"), (503, "٣")]
    frame = spark.createDataFrame(
        texts + [(i, t, None, None) for i, t in odd] + [texts[0]],
        "doc_id BIGINT, text STRING, `score` STRING, `x.y` DOUBLE",
    )
    found = language.detect_language(frame, dictionaries).collect()
    assert len(found) == 105 and found[0]["x.y"] is not None
    by_id = {r.doc_id: r for r in found}
    right = sum(by_id[i].lang_pred == lang for i, _, lang in test)
    assert right >= 98
    assert all(0 <= r.score <= 1 for r in found)
    for i, _ in odd:
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    mixed = " ".join(" ".join(v.split()) for v in LANGUAGES.values())
    frame = frame.limit(1).select("doc_id", F.lit(mixed).alias("text"))
    assert language.detect_language(frame, dictionaries, min_margin=0.5).first().rejected
    assert language.detect_language(frame, {}).first().lang_pred == "und"
    assert language.detect_language(frame.limit(0), dictionaries).count() == 0


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, t, lang) for i, t, lang in language_texts(4, 150) if lang != "yy"]
    chance, parts = random.Random(4), LANGUAGES["yy"].split()
    for i in range(20):
        words = ["".join(chance.choices(parts, k=2)) for _ in range(8000)]
        rows.append((1000 + i, " ".join(words), "yy"))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    learned = language.learn_dictionaries(docs)
    assert sorted(learned) == ["xx", "yy", "zz"]
    assert all(len(v) <= language.DICTIONARY_BYTES for v in learned.values())
    found = language.detect_language(docs, learned).collect()
    assert sum(r.lang_pred == r.lang and not r.rejected for r in found) >= 0.98 * len(rows)
    assert all(r.lang_pred == "yy" for r in found if r.lang == "yy")
    with pytest.raises(ValueError):
        language.learn_dictionaries(docs, most_languages=1)
    assert language.learn_dictionaries(docs.limit(0)) == {}


def test_dictionary_sample_is_bounded(spark):
    frame = spark.createDataFrame(language_texts(3, 300), "doc_id BIGINT, text STRING, lang STRING")
    dictionaries = language.learn_dictionaries(frame, sample_texts=2, dictionary_bytes=600)
    assert all(0 < len(d) <= 600 for d in dictionaries.values())
    assert language.learn_dictionaries(frame.limit(0)) == {}


def quality_rows(seed, count):
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        words = prose(chance.randint(0, 10**6), chance.randint(20, 120)).split()
        good = chance.random() < 0.7
        if not good:
            words = [w + chance.choice("#*$%") if chance.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words) + ".", int(good)))
    return rows


def brute_statistics(text):
    """The fourteen statistics of a text, counted character by character."""
    data = (text or "").encode()
    words = [w.encode() for w in words_of(text)]
    lengths, lines = [len(w) for w in words], [x for x in data.split(b"\n") if x]
    upper = sum(65 <= c <= 90 for c in data)
    letters = upper + sum(97 <= c <= 122 or c >= 128 for c in data) + 1
    size = len(data) + 1

    def share(members):
        return math.sqrt(sum(c in members for c in data) / size)

    mean = sum(lengths) / len(lengths) if words else 0
    spread = math.sqrt(sum((n - mean) ** 2 for n in lengths) / len(lengths)) if words else 0
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    entropy = -sum(n / size * math.log(n / size) for n in collections.Counter(data).values())
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), math.sqrt(upper / letters),
        share(b"#*$%&|<>@^~\\_={}[]/+`"), share(b".?"), share(b",;:"), share(b"0123456789"),
        share(b"!"), math.log((len(set(words)) + 1) / (len(words) + 1)) / math.log(len(words) + 2),
        math.sqrt(doubled / (len(words) + 1)),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0,
        math.log1p(len(data) / len(lines)) if lines else 0, entropy,
    ]


def test_statistics_match_brute_force(documents):
    texts = [None, "", " ", "\n\n", "a a a", "é!", "x " * 5000, "A1,b.c?\nA1,b.c?\n#", "w" * 300_000]
    texts += [prose(s, 80).upper() + "!?;\n" + prose(s, 20) for s in range(10)]
    rows = discriminant.document_statistics(documents(*texts)).collect()
    assert len(rows) == len(texts) and len(discriminant.STATISTICS) == 14
    for r in rows:
        assert r.statistics == pytest.approx(brute_statistics(texts[r.id]), abs=1e-9)


def test_discriminant_separates_held_out_texts(spark):
    rows = quality_rows(1, 600) + [(600, None, 0), (601, "", 0), (602, " ", None), (None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, quality INT")
    found = discriminant.document_statistics(frame)
    labelled = found.join(frame.selectExpr("doc_id AS id", "quality"), "id")
    held = F.coalesce(bucket_of(F.col("id"), 3) == 1, F.lit(False))
    model = discriminant.fit(labelled.filter(~held))
    scored = discriminant.score(found, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    truth = {i: q for i, _, q in rows}
    held_out = [r for r in scored if r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1]
    held_out = [r for r in held_out if truth[r.id] is not None]
    assert len(held_out) > 150
    assert sum((r.score >= 0.5) == bool(truth[r.id]) for r in held_out) >= 0.97 * len(held_out)


def test_discriminant_matches_densities(spark):
    chance = np.random.default_rng(5)
    size = len(discriminant.STATISTICS)
    values = chance.normal(size=(400, size)) * np.linspace(1, 2, size)
    labels = (chance.random(400) < 0.4).astype(int)
    values[labels == 1] += 0.5
    frame = spark.createDataFrame(
        [(v.tolist(), int(q)) for v, q in zip(values, labels)],
        "statistics ARRAY<DOUBLE>, quality INT",
    )
    model = discriminant.fit(frame)
    spread = [np.cov(values[labels == c].T, bias=True) for c in (0, 1)]
    counts = np.bincount(labels)
    pooled = (counts[0] * spread[0] + counts[1] * spread[1]) / 400
    d, p = discriminant.TO_DIAGONAL, discriminant.TO_POOLED
    pooled = (1 - d) * pooled + d * (np.diag(np.diag(pooled)) + discriminant.RIDGE * np.eye(size))
    terms = []
    for c in (0, 1):
        cov = (1 - p) * spread[c] + p * pooled
        away = values - values[labels == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
        terms.append(np.log(counts[c] / 400) - 0.5 * (np.linalg.slogdet(cov)[1] + distance))
    assert np.allclose(model.log_odds(values), terms[1] - terms[0])
    one_class = frame.filter("quality = 1")
    assert discriminant.fit(one_class) is None and discriminant.fit(frame.limit(0)) is None
    assert discriminant.score(frame, None).first().score == 0.5


MIT = licences.LICENCES["MIT"][0]


def test_whole_licences_are_found_in_any_dress(documents):
    dressed = "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + MIT.upper().replace(", ", ",\n\t")
    british = "© 2019 X\n" + MIT.replace("sublicense", "sub-licence").replace("HOLDERS", "OWNERS")
    texts = [MIT, dressed, british, MIT + " extra", "Released under the MIT licence", None, "", "..."]
    texts += ["Copyright 2020 Jane", "story\nLicensed under CC BY-NC 4.0.\nmore\nReleased under the MIT License."]
    docs = documents(*texts)
    rows = licences.scan_licences(docs.union(docs.filter("doc_id >= 8"))).collect()
    assert len(rows) == len(texts) + 2
    by_id = {r.id: r for r in rows}
    assert [by_id[i].license_id for i in range(10)] == ["MIT"] * 3 + [None, "MIT"] + [None] * 5
    assert all(by_id[i].digest is None for i in (5, 6, 7, 8))
    assert by_id[9].notices == ["CC-BY-NC-4.0", "MIT"] and by_id[9].n_notices == 2
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_whole_licences_are_found_at_every_width(documents):
    british = MIT.replace("sublicense", "sub licence")
    texts = [british, *(x[0] for n, x in licences.LICENCES.items() if n[0] in "I0ZB")]
    wanted = ["MIT", *(n for n in licences.LICENCES if n[0] in "I0ZB")]
    wrapped = [
        "\n".join(textwrap.fill(line, width) for line in text.split("\n"))
        for text in texts
        for width in range(40, 121)
    ]
    rows = licences.scan_licences(documents(*wrapped)).collect()
    missed = [(wanted[r.id // 81], 40 + r.id % 81) for r in rows if r.license_id != wanted[r.id // 81]]
    assert len(rows) == len(wrapped) and missed == []


def test_long_public_texts_are_found_whole(documents):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only"}
    names |= {"LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"/usr/share/common-licenses/{n}").read() for n in names]
    rows = licences.scan_licences(documents(*texts, texts[0] + " extra")).collect()
    assert [r.license_id for r in sorted(rows, key=lambda r: r.id)] == [*names.values(), None]


def test_given_digests_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "My Terms!"), (None, "My Terms!"), (1, "x")], "doc_id INT, text STRING")
    known = docs.limit(1).select(
        licences.digest(F.lit("my terms")).alias("digest"), F.lit("own").alias("license_id")
    )
    rows = licences.scan_licences(docs, known).collect()
    assert sorted((r.id, r.license_id) for r in rows if r.id is None) == [(None, "own")] * 2
    assert len(rows) == 3


def test_rows_of_one_id_stay_apart(documents):
    line = "Released under the MIT License."
    docs = documents(line, first=5).union(documents("Released under\nthe MIT License.", first=5))
    docs = docs.union(documents(line, first=5))
    rows = licences.scan_licences(docs).collect()
    assert len({r.digest for r in rows}) == 1
    assert sorted((r.n_notices, r.notices) for r in rows) == [(0, []), (1, ["MIT"]), (1, ["MIT"])]


def test_licence_terms_are_no_copyright_lines(spark):
    frame = spark.createDataFrame(
        [("copyright notice and this permission notice\nCopyright Jane\nthe copyright owner",)],
        "text STRING",
    )
    units = frame.select(licences.canonical_units(F.col("text")).alias("u")).first().u
    assert units == ["copyright notice and this permission notice", "the copyright owner"]
