"""Approximate nearest neighbours by largest inner product, with a hash-prefix forest.

Rows are dealt by a hash of id and vector into blocks of bounded size, queries into chunks; each block answers each chunk
and the blocks' best are merged. A block's forest has ``TREES`` sorted arrays of ``BITS``-bit hash strings, each bit the
side of a random hyperplane. A query descends in every tree to its longest prefix match, then all trees ascend together,
one bit at a time, until the ranges that share the prefix hold ``POOL`` times the block's vectors, over all trees. A
vector's matches, over trees and levels, are pooled: the candidates are the ``SHARE`` of the block with most of them,
``LEAST`` at least, ties included. So that angles follow inner products, vectors get one more component that makes their
norms equal. Candidates are ranked by their inner product in double precision.

Strings are made of vectors divided by the block's greatest component (queries by their own), so no finite vector
overflows. Blocks are bounded, so the candidates of a query in a block are, too. Equal vectors of a block are indexed once,
with the smallest ids that can rank, so a very common vector costs no more than another.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of another length than the query's are no candidates for it; rows alike in id and vector count once; a
query leaves out its own row alone, so rows that repeat an id with other vectors are candidates of each other and, where
they ask, each gets its ranks under the id. Where a product overflows it counts, and is given, as infinite. Ties go to the
smaller id; fewer candidates than k all come back. Columns other than those named are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, POOL, SHARE, LEAST = 128, 32, 4, 0.1, 512
BLOCK_ROWS, LEAST_BLOCKS, CHUNK_ROWS = 100_000, 8, 50_000
#: Queries that ascend at once.
STEP = 256


class Forest:
    """A hash-prefix forest over vectors (rows of x, distinct)."""

    def __init__(self, x: np.ndarray, seed: int = 11, trees: int = TREES):
        x = x / np.abs(x).max()
        norms = (x * x).sum(axis=1)
        x = np.column_stack([x, np.sqrt(norms.max() - norms)]).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.n = len(x)
        self.planes = [rng.normal(size=(x.shape[1], BITS)).astype(np.float32) for _ in range(trees)]
        self.sorted: list[np.ndarray] = []
        self.order = np.empty((trees, self.n), np.int32)
        for t, planes in enumerate(self.planes):
            code = self.strings(x, planes)
            self.order[t] = np.argsort(code, kind="stable")
            self.sorted.append(code[self.order[t]])

    @staticmethod
    def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        sides = np.packbits((x @ planes) > 0, axis=1)
        return sides.view(f">u{BITS // 8}").ravel().astype(np.int64)

    def ascent(self, queries: np.ndarray, pool: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By level from the longest prefix, for each tree and query the range of sorted strings that share it, and the
        level at which each query's ranges hold ``pool`` vectors."""
        q = queries / np.abs(queries).max(axis=1, keepdims=True)
        q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        codes = [self.strings(q, p) for p in self.planes]
        lows, highs = [], []
        last = np.full(len(q), -1)
        # Beyond this many bits a prefix is shared by hardly anything but its longest match.
        for level in range(min(BITS, self.n.bit_length()), -1, -1):
            low, high = (np.empty((len(codes), len(q)), np.int32) for _ in range(2))
            for t, code in enumerate(codes):
                prefix = code >> (BITS - level) << (BITS - level)
                low[t] = np.searchsorted(self.sorted[t], prefix)
                high[t] = np.searchsorted(self.sorted[t], prefix + (1 << (BITS - level)))
            lows.append(low)
            highs.append(high)
            last[(last < 0) & ((high - low).sum(axis=0) >= pool)] = len(lows) - 1
            if (last >= 0).all():
                break
        last[last < 0] = len(lows) - 1
        return lows, highs, last

    def candidates(self, queries: np.ndarray, pool: int, most: int) -> Iterator[np.ndarray]:
        """For each query the places of its candidates, those with most matches: ``most`` of them, and ties."""
        if self.n <= most:
            yield from (np.arange(self.n) for _ in queries)
            return
        flat = self.order.ravel()
        base = (np.arange(len(self.planes)) * self.n)[:, None]
        for begin in range(0, len(queries), STEP):
            lows, highs, last = self.ascent(queries[begin : begin + STEP], pool)
            low, high = np.stack(lows, axis=1), np.stack(highs, axis=1)  # trees x levels x queries
            for i, level in enumerate(last.tolist()):
                a, b = low[:, : level + 1, i], high[:, : level + 1, i]
                sizes = (b - a).ravel()
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat((a + base).ravel() - (ends - sizes), sizes)
                matches = np.bincount(flat[at], minlength=self.n)
                cut = np.partition(matches, self.n - most)[self.n - most]
                yield np.flatnonzero(matches >= cut)


def products(own: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; where these overflow on the way, infinite of the right sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (own * q).sum(axis=1)
        odd = ~np.isfinite(score)
        if odd.any():
            x = own[odd]
            a, b = np.frexp(np.abs(x).max(axis=1))[1], np.frexp(np.abs(q).max())[1]
            score[odd] = np.ldexp((np.ldexp(x, -a[:, None]) * np.ldexp(q, -b)).sum(axis=1), a + b)
    return score


def block_neighbours(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE, least: int = LEAST
) -> list[tuple[int, int, int, float]]:
    """(query's place, query id, id, score) of each query's k best candidates among the vectors of one block."""
    own, place = np.unique(x, axis=0, return_inverse=True)
    place = place.ravel()
    by_class = np.lexsort((ids, place))
    starts = np.searchsorted(place[by_class], np.arange(len(own) + 1))
    forest = Forest(own)
    out: list[tuple[int, int, int, float]] = []
    found = forest.candidates(queries, POOL * len(own), max(least, 2 * (k + 1), int(share * len(own))))
    for n, (q, query_id, c) in enumerate(zip(queries, query_ids.tolist(), found)):
        score = products(own[c], q)
        if len(c) > k + 1:
            near = score >= np.partition(score, len(c) - k - 1)[len(c) - k - 1]
            c, score = c[near], score[near]
        met: list[tuple[float, int]] = []
        order = np.argsort(-score, kind="stable")
        for s, place_of in zip(score[order].tolist(), c[order].tolist()):
            if len(met) >= k and s < met[k - 1][0]:
                break
            # Ids of a class ascend, so its first k + 1 hold all that can rank, the query's own left out.
            members = ids[by_class[starts[place_of] : min(starts[place_of + 1], starts[place_of] + k + 1)]].tolist()
            if query_id in members and (own[place_of] == q).all():
                members.remove(query_id)
            met += [(s, i) for i in members]
        met.sort(key=lambda m: (-m[0], m[1]))
        out += [(n, query_id, i, s) for s, i in met[:k]]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite throughout and not zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def nearest(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which queries holds, among all other rows."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    got = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    blocks, chunks = max(LEAST_BLOCKS, -(-got["n"] // BLOCK_ROWS)), max(1, -(-got["asked"] // CHUNK_ROWS))
    # Adding 0.0 makes the zeros' signs alike.
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + 0.0))
    rows = rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")).withColumn("key", F.xxhash64("id", "vector"))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(5)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("id", "vector", dealt(blocks).alias("block"), every(chunks).alias("chunk"))
    right = rows.where("asks").select("id", "key", "vector", dealt(chunks).alias("chunk"), every(blocks).alias("block"))

    def answer(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        sizes, wanted = part["vector"].map(len).to_numpy(), asked["vector"].map(len).to_numpy()
        for size in np.unique(wanted):
            a, b = part[sizes == size], asked[wanted == size]
            if len(a):
                got = block_neighbours(a["id"].to_numpy(), np.stack(a["vector"].to_list()), b["id"].to_numpy(), np.stack(b["vector"].to_list()), k)
                made = pd.DataFrame(got, columns=["key", "query_id", "vec_id", "score"])
                out.append(made.assign(key=b["key"].to_numpy()[made["key"].to_numpy(np.int64)]))
        made = pd.concat(out) if out else pd.DataFrame([], columns=["key", "query_id", "vec_id", "score"])
        return made.astype({"key": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (
        left.groupBy("block", "chunk")
        .cogroup(right.groupBy("block", "chunk"))
        .applyInPandas(answer, "key long, query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
