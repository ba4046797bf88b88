import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for q, v in queries:
        score = (x * v).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(score.tolist(), ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf, size):
    df = spark.read.parquet(sf.replace("sf0.001", size) + "/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    want = brute(ids, x, [(i, v) for i, v in zip(ids, x) if i % 20 == 0], 20)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    by_id = dict(zip(ids, x))
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == (by_id[q] * by_id[i]).sum() for i, s in found)


def test_norms_ties_copies_and_odd_vectors(spark):
    """Few vectors: all are candidates, so the answer is exact; norms differ, and many are equal."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8)) * rng.uniform(0.1, 9, (30, 1))
    rows = [(i, base[i % 30 if i < 60 else 0].tolist()) for i in range(140)]
    odd = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7),
           (205, []), (206, [1.0, 2.0]), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + odd], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    want = brute(ids, x, [(i, v) for i, v in zip(ids, x) if i % 20 == 0], 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0])], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 0.5)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_a_whole_block_is_searched_by_few_candidates():
    """One block of many vectors without clusters: a tenth of it is ranked, and recall holds."""
    x = np.random.default_rng(2).normal(size=(12_000, 32)) * np.random.default_rng(3).uniform(0.5, 2, (12_000, 1))
    ids = np.arange(len(x))
    queries = ids[::200]
    found = list(ann.Forest(x).candidates(x[queries], ann.POOL * len(x), int(ann.SHARE * len(x))))
    assert max(len(c) for c in found) <= 0.15 * len(x)
    want = brute(ids.tolist(), x, [(i, x[i]) for i in queries.tolist()], 20)
    got = {}
    for _, q, i, _ in ann.block_neighbours(ids, x, queries, x[queries], 20):
        got.setdefault(q, []).append(i)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("size", [1e-150, 1e20, 1e150])
def test_large_and_small_finite_vectors(spark, size):
    x = np.random.default_rng(4).normal(size=(60, 8)) * size
    rows = list(enumerate(x.tolist()))
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(range(60), x, [(i, x[i]) for i in (0, 20, 40)], 20)


def test_products_that_overflow(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e300, 0.0]), (2, [1.0, 0.0]), (3, [-1e300, 1e300]), (4, [-1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, np.inf), (2, 1e300), (3, 0.0), (4, -np.inf)]


def test_rows_that_repeat_an_id(spark):
    """Only rows alike in id and vector count once; a row of the query's id with another vector is a candidate."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [0.9, 0.0]), (1, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0, 20).collect()]
    first = [(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.25)]
    second = [(1, 0, 0.5), (2, 1, 0.45), (3, 1, 0.125)]
    assert sorted(got) == sorted(first + second)
