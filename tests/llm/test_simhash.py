import random

import numpy as np
import pytest
import xxhash
from folioflow.llm import simhash
from folioflow.llm.graph import components, forest


def brute_fingerprint(text):
    """Bits set in over half of the hashes of all runs of three words."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    runs = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def random_texts(seed, count):
    chance = random.Random(seed)
    vocabulary = ["".join(chance.choices("abcdeé", k=chance.randint(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(count):
        words = chance.choices(vocabulary, k=chance.randint(60, 200))
        texts.append(" ".join(words))
        for _ in range(chance.randint(0, 4)):
            near = list(words)
            near[chance.randrange(len(near))] = chance.choice(vocabulary)
            texts.append("\t".join(near) if chance.random() < 0.3 else " ".join(near).upper())
    return texts


def test_fingerprints_match_brute_force():
    texts = [None, "", " \n\t", "One", "one two", "a b c", "A  b\tC d", "É é À"]
    texts += random_texts(1, 20) + ["w " * 1000 + "x"]
    encoded = [None if t is None else t.encode() for t in texts]
    got = simhash.majority_bits([simhash.shingle_hashes(t) for t in encoded])
    assert [int(v) for v in got] == [brute_fingerprint(t) for t in texts]


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_bit_planes_find_every_pair(radius):
    chance = np.random.default_rng(radius)
    values, group, side = [], [], []
    for g in range(40):
        base = int(chance.integers(1 << 62)) << 2
        kind = int(chance.integers(2))
        for _ in range(int(chance.integers(1, 150))):
            flips = chance.integers(64, size=chance.integers(0, radius + 4))
            value = base
            for f in flips:
                value ^= 1 << int(f)
            values.append(value)
            group.append(g)
            side.append(int(chance.integers(2)) if kind else 2)
    values = np.array(values, dtype=np.uint64)
    group, side = np.array(group), np.array(side)
    order = list(range(64))
    got = set()
    for left, right in simhash.close_pairs(values, group, side, order, radius):
        got |= set(zip(left.tolist(), right.tolist()))
    expected = {
        (i, j)
        for i in range(len(values))
        for j in range(i + 1, len(values))
        if group[i] == group[j]
        and (side[i] == 2 or side[i] != side[j])
        and (int(values[i]) ^ int(values[j])).bit_count() <= radius
    }
    assert got == expected


def test_masks_leave_no_pair_apart():
    chance = random.Random(3)
    for pieces in (4, 5, 6, 7):
        masks = simhash.piece_masks(3, pieces)
        for _ in range(300):
            a = chance.getrandbits(64)
            b = a
            for bit in chance.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    assert len(simhash.masks_for(10**10, 3)) > len(simhash.masks_for(10**5, 3))


@pytest.mark.parametrize("chunk", [1024, 7])
def test_components_match_brute_force(documents, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = [None, "", "  ", *random_texts(5, 40)]
    texts += [texts[5]] * 30 + [texts[6] + " tail"]
    docs = documents(*texts)
    docs = docs.union(docs.filter("doc_id = 7"))
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.id: r.fingerprint % (1 << 64) for r in rows} == prints
    edges = [
        (a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3
    ]
    assert {r.id: r.component_id for r in rows} == brute_components(prints, edges)
    assert len(rows) == len(texts) + 1
    assert len(set(brute_components(prints, edges).values())) < len(set(prints.values()))


def test_empty_table_and_null_ids(spark, documents):
    assert simhash.near_duplicates(documents("a").limit(0)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d")], "doc_id BIGINT, text STRING")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {4}


def test_fingerprint_text(spark):
    frame = spark.createDataFrame([(-1,), (0,), (255,)], "fingerprint BIGINT")
    texts = [r[0] for r in frame.select(simhash.fingerprint_text()).collect()]
    assert texts == ["f" * 16, "0" * 16, "00000000000000ff"]


def test_graph_components_on_chains_hubs_and_random_edges(spark):
    chance = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 180)]
    edges += [(1000, i) for i in range(1001, 1200)] + [(5000 - i, 5000) for i in range(1, 50)]
    edges += [(chance.randrange(200), chance.randrange(200)) for _ in range(60)] + [(7, 7)]
    frame = spark.createDataFrame(edges + [(3, None)], "a BIGINT, b BIGINT")
    got = {r.node: r.root for r in components(frame).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(frame.limit(0)).count() == 0


def test_forest_matches_brute_force():
    chance = np.random.default_rng(2)
    left, right = chance.integers(300, size=(2, 200))
    expected = brute_components(range(300), zip(left.tolist(), right.tolist()))
    assert forest(300, left, right).tolist() == [expected[i] for i in range(300)]
