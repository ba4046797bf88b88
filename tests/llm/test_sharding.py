import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm.sharding import interleaved_shards


def check(rows, sources, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    # A cut of the interleaved order holds each source in proportion, but for rounding: half a row of the source itself at
    # either end, and its share of half a row of every source.
    total = Counter(sources.values())
    for s in range(shards):
        mix = Counter(sources[r["doc_id"]] for r in rows if r["shard"] == s)
        for source, n in total.items():
            assert abs(mix[source] - n * sizes[s] / len(rows)) <= 1 + n / len(rows) * len(total)


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_rows_and_mixture(spark, shards):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 13) END AS source", "repeat('é', id % 5) AS text")
    rows = interleaved_shards(docs, shards).collect()
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert len(rows) == 3000
    check(rows, sources, shards)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_matches_brute_force(spark):
    """Ranks by hand: shuffle each source by the seeded hash, sort by fractional rank, cut."""
    import hashlib

    # Sources of many rows, of few, and of one; fewer rows than buckets and more.
    source = "CASE WHEN id < 30 THEN concat('few', id % 7) WHEN id = 30 THEN NULL ELSE concat('s', id % 2) END"
    docs = spark.range(500).selectExpr("id AS doc_id", f"{source} AS source", "'t' AS text")
    groups, crc = {}, zlib.crc32(b"t")
    for r in docs.collect():
        key = hashlib.md5(f"lodestone:{r['doc_id']}:{crc}:2:1".encode()).hexdigest()
        groups.setdefault(r["source"] or "", []).append((key, r["doc_id"]))
    order = sorted(((2 * k + 1) / (2 * len(g)), s, h, d) for s, g in groups.items() for k, (h, d) in enumerate(sorted(g)))
    want = {d: (((at + 1) * 16 - 1) // 500) for at, (*_, d) in enumerate(order)}
    for buckets in (None, 16, 3):
        got = {r["doc_id"]: r["shard"] for r in interleaved_shards(docs, 16, buckets=buckets).collect()}
        assert got == want


def test_a_hot_id_and_rows_that_are_alike(spark):
    """They are dealt over the shards like any others."""
    docs = spark.range(600).selectExpr("if(id < 400, 1, id) AS doc_id", "'s' AS source", "if(id < 300, 'same', concat('t', id)) AS text")
    rows = interleaved_shards(docs, 4).collect()
    assert len(rows) == 600 and Counter(r["shard"] for r in rows) == dict.fromkeys(range(4), 150)
    alike = Counter(r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"same"))
    assert sum(alike.values()) == 300 and min(alike.values()) > 50


def test_edges(edge_docs, no_docs):
    rows = interleaved_shards(edge_docs, 3, keep=("lang",)).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(Counter(r["shard"] for r in rows).values()) in ([3, 4, 4], [4, 4, 3])
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert interleaved_shards(no_docs, 3).count() == 0
    with pytest.raises(ValueError):
        interleaved_shards(no_docs, 0)


def test_same_on_other_partitions(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "'t' AS text")
    one = interleaved_shards(docs.repartition(7, F.rand(1)), 5).orderBy("doc_id").collect()
    assert one == interleaved_shards(docs.coalesce(1), 5).orderBy("doc_id").collect()
