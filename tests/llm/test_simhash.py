import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, threshold=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    rng = random.Random(2)
    words = ["A", "bÉ", "the", "İ", "x y", " ", "\x1c", "z\x85", "Word", "\t", "\n"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("threshold", range(1, 9))
@pytest.mark.parametrize("count", [0, 10**10])
def test_every_pair_within_the_threshold_meets_at_a_home(threshold, count):
    rng = np.random.default_rng(3)
    own = simhash.codes(threshold, count)
    assert all(sum(t + 1 for _, t in way) > threshold and sum(b for b, _ in way) == 64 for way in simhash.segmentations(threshold))
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, int(rng.integers(0, threshold + 1)), replace=False):
            y ^= 1 << int(b)
        fx, fy = np.array([x], np.uint64), np.array([y], np.uint64)
        assert any(c.home(fx)[0] in c.replicas(fy)[0] for c in own)


def test_the_number_of_fingerprints_chooses_the_codes():
    few, many = ([(c.bits, c.coded) for c in simhash.codes(4, n)] for n in (10**5, 10**10))
    assert few == [(24, True), (24, True), (16, False)] and len(many) == 2 and all(coded for _, coded in many)
    with pytest.raises(ValueError):
        simhash.codes(30)


@pytest.mark.parametrize(("hot", "replica_cost"), [(simhash.HOT, simhash.REPLICA_COST), (8, simhash.REPLICA_COST), (simhash.HOT, 0)])
def test_links_match_brute_force(spark, monkeypatch, hot, replica_cost):
    """Also with anchors dealt out to cells, and with the codes for many fingerprints."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "REPLICA_COST", replica_cost)
    rng = random.Random(4)
    prints = {}
    for i in range(400):
        base = rng.choice(list(prints.values())) if prints and rng.random() < 0.6 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 4, 4, 5])):
            base ^= 1 << b
        prints[i] = base
    distinct = sorted(set(prints.values()))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in distinct], "fp long")
    linked = components(simhash.similar_fingerprints(df))
    got = {int(np.int64(r["node"]).astype(np.uint64)): int(np.int64(r["root"]).astype(np.uint64)) for r in linked.collect()}
    want = brute_components({p: p for p in distinct})
    groups = lambda roots: sorted(map(sorted, {r: [p for p in distinct if roots[p] == r] for r in roots.values()}.values()))
    assert groups({p: got.get(p, p) for p in distinct}) == groups(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[j] == 1000 for j in range(1000, 1100))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    assert {d: int(np.int64(r["fp"]).astype(np.uint64)) for d, r in rows.items()} == prints
    assert {d: r["component_id"] for d, r in rows.items()} == brute_components(prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(prints).values()))


def test_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["fp"] == by[4][0]["fp"] == by[5][0]["fp"] == 0 and by[4][0]["component_id"] == 3
    assert {r["component_id"] for r in by[None]} == {None, 3}
    assert len(by[2]) == 2 and by[2][0]["component_id"] == 1
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_one(edge_docs).select("doc_id").collect())
    assert [d for n, d in kept if not n] == [1, 3, 6, 7, 8] and sum(n for n, _ in kept) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def test_texts_that_share_an_id_stay(spark):
    texts = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (1, "one two three four five six"), (2, "one two three four five six")]
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted(set(texts[:2]))
