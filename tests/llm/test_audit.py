import random
from itertools import permutations

import pytest
from folioflow.llm import audit
from pyspark.sql import functions as F

DOCS = "doc_id BIGINT, text STRING, lang STRING, bits INT, part STRING, hash BIGINT"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def words_of(text):
    for white in "\t\n\v\f\r":
        text = text.replace(white, " ")
    return [w for w in text.split(" ") if w]


def failures(rows):
    """Of each row the letters of the filters that it fails, by direct comparison."""
    result = []
    for ident, text, _ in rows:
        text = text or ""
        words = words_of(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if ident is not None and any(
            i is not None and i < ident and (t or "") == text for i, t, _ in rows
        ):
            fails.add("E")
        result.append(fails)
    return result


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = failures(rows)
    found = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, failed) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                found[part, "".join(order), step + 1] = (
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone),
                    sum(f == {name} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                found[part, "".join(order), step + 1] += (shapley[name],)
    return found


def found_audit(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 1, "x", 2) for i, t, p in rows], DOCS)
    marks = audit.document_labels(spark.createDataFrame(labels, LABELS))
    result = audit.interaction_audit(audit.failure_bits(docs), marks).collect()
    return {
        (r.part, r.filter_order, r.step): (
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        )
        for r in result
    }


def some_rows(seed, count):
    chance = random.Random(seed)
    known = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "a$", "AB c", "é" * 100 + "ABCD", "x " * 199, "x " * 200]
    for _ in range(25):
        size = chance.choice([10, 199, 200, 300])
        words = chance.choices(known[: chance.choice([20, 400])], k=size)
        text = chance.choice([" ", "\t", " \v"]).join(words)
        if chance.random() < 0.3:
            text += chance.choice(["#", "|", " & "])
        if chance.random() < 0.3:
            text = "CAPS" * chance.randint(1, 12) + " " + text
        texts.append(text)
    rows = []
    for _ in range(count):
        ident = chance.choice([None, *range(60)])
        rows.append((ident, chance.choice(texts), chance.choice([None, "", "en", "de"])))
    return rows + rows[:9] + [(200 + i, texts[8], "hot") for i in range(40)]


@pytest.mark.parametrize("salt_rows, broadcast", [(2048, 1 << 20), (7, 0)])
def test_audit_matches_brute_force(spark, monkeypatch, salt_rows, broadcast):
    whole = audit.earlier_copies
    monkeypatch.setattr(
        audit, "earlier_copies", lambda *a: whole(*a, broadcast_hashes=broadcast, salt_rows=salt_rows)
    )
    rows = some_rows(salt_rows, 150)
    chance = random.Random(1)
    labels = [(chance.choice([None, *range(60)]), chance.choice([0, 1, None]), chance.choice([0, 1, None])) for _ in range(70)]
    assert found_audit(spark, rows, labels) == brute_audit(rows, labels)


def test_equal_hashes_do_not_make_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "a")], "doc_id INT, text STRING")
    # All rows are said to share one hash: only equal texts may count.
    hashes = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = audit.earlier_copies(docs, hashes.union(hashes.withColumn("id", F.col("id") + 10)))
    assert sorted(r.id for r in found.collect()) == [3, 4]


def test_orders_and_an_empty_table(spark):
    steps = list(audit.order_steps("AB"))
    assert steps == [("AB", 1, 0, 1), ("AB", 2, 1, 2), ("BA", 1, 0, 2), ("BA", 2, 2, 1)]
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING")
    marks = audit.document_labels(spark.createDataFrame([], LABELS))
    assert audit.interaction_audit(audit.failure_bits(docs), marks).count() == 0


def test_very_long_texts_are_looked_at_whole():
    long = "w" * 3_000_000
    assert audit.text_failures(long.encode()) == 0b0001
    assert audit.text_failures((long + "|").encode()) == 0b1001
    assert audit.text_failures(("a b " * 500_000).encode()) == 0b0010
