"""SimHash near-duplicates by anchor-point covering.

A covering code's words are the anchors. Each fingerprint has a home anchor within the code's covering radius R and is
replicated to every anchor within R plus the threshold t; two fingerprints within t of each other then meet at either's
home. The fingerprint is cut into segments with thresholds
t_i, and whichever way ``t`` differing bits fall, some segment has t_i of them at most (the t_i + 1 add up to t + 1).
Each segment has its own code: a shortened product of the perfect Hamming [15, 11] code, R = 1, with plain bits, or for
t_i = 0 all words, R = 0. Fewer segments have more replicas and far more anchors, so the number of fingerprints chooses:
for t = 4, segments of (24, 24, 16) bits with thresholds (1, 1, 0) and 39 replicas on average for up to two thousand million
fingerprints, beyond it two segments with thresholds 2 and 1.

Equal fingerprints are counted once. Each anchor's fingerprints are compared where they meet and leave a spanning forest
of their links, not all pairs. An anchor that is home to more than ``HOT`` fingerprints is dealt out to a grid of cells.

Defined results: A-Z are lower-cased; words are what stands between space and \\t\\n\\v\\f\\r; null, empty and blank texts
have the fingerprint 0, which links like any other; texts with fewer words than a shingle are one shingle; whole texts
count, repeated shingles included. A null id links like any other, and never is a component's smallest id unless all its
ids are null (then the component's id is null). Repeated rows come out as often as they come in. Columns other than
those named are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.components import components

HAMMING_BITS = 15
#: What a replica costs, in comparisons; bits that a segment with threshold 0, 1 or 2 gets in proportion.
REPLICA_COST, BITS_OF = 200, (2, 3, 4)
#: Home fingerprints from which an anchor is dealt out to cells, and hot anchors that may be broadcast.
HOT, MOST_BROADCAST = 2048, 100_000
#: Fingerprints of a run that are compared at once with all others of it.
BLOCK = 256


def fingerprint(text: str | None, words_in: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= words_in:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.fromiter(map(len, words), np.int64, len(words))
        ends += 1
        np.cumsum(ends, out=ends)
        starts = [0, *ends[: -words_in].tolist()]
        digest = xxhash.xxh64_intdigest
        stops = (ends[words_in - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, stops)), np.uint64, len(stops))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words_in: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: the id, and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), words_in, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


class SegmentCode:
    """The covering code of one segment: for threshold 0 all words, else Hamming words on 15 bits and any on the rest."""

    def __init__(self, number: int, shift: int, bits: int, threshold: int):
        self.number, self.shift, self.bits, self.coded = number, np.uint64(shift), bits, threshold > 0
        self.mask = np.uint64((1 << bits) - 1)
        radius = 1 if self.coded else 0
        masks = [sum(1 << b for b in at) for w in range(radius + threshold + 1) for at in combinations(range(bits), w)]
        self.reach: dict[int, list[int]] = {}
        for m in masks if self.coded else [0]:
            self.reach.setdefault(int(self.syndrome(np.array([m], np.uint64))[0]), []).append(m)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """The Hamming syndrome of the coded bits: the exclusive or of the numbers, from 1, of those set."""
        out = np.zeros(len(x), np.int64)
        if self.coded:
            for b in range(HAMMING_BITS):
                out ^= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) * (b + 1)
        return out

    def segment(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.shift) & self.mask

    def named(self, anchors: np.ndarray) -> np.ndarray:
        return anchors.astype(np.int64) | (self.number << 40)

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The anchor within the covering radius of each fingerprint."""
        x = self.segment(fps)
        s = self.syndrome(x)
        flip = np.where(s > 0, np.left_shift(1, np.maximum(s - 1, 0)), 0).astype(np.uint64)
        return self.named(x ^ flip)

    def replicas(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors within radius plus threshold, and the index of the fingerprint of each."""
        x = self.segment(fps)
        s = self.syndrome(x)
        anchors, index = [], []
        for syndrome, masks in self.reach.items():
            at = np.flatnonzero(s == syndrome)
            if len(at):
                anchors.append((x[at][:, None] ^ np.array(masks, np.uint64)[None, :]).ravel())
                index.append(np.repeat(at, len(masks)))
        return self.named(np.concatenate(anchors)), np.concatenate(index)


def segmentations(threshold: int) -> list[list[tuple[int, int]]]:
    """Ways to cut 64 bits into segments (bits, threshold) of which one is not over its threshold."""
    ways = []
    for twos in range(threshold + 1):
        rest = threshold + 1 - 3 * twos
        if rest < 0:
            break
        parts = [2] * twos + [1] * (rest // 2) + [0] * (rest % 2) if threshold > 1 else [0, 0]
        whole = sum(BITS_OF[t] for t in parts)
        bits = [64 * BITS_OF[t] // whole for t in parts]
        bits[0] += 64 - sum(bits)
        if all(b <= 40 and (t == 0 or b >= HAMMING_BITS) for b, t in zip(bits, parts)):
            ways.append(list(zip(bits, parts)))
    return ways


def cost(way: list[tuple[int, int]], count: int) -> float:
    """Replicas of a fingerprint, and comparisons with its home anchors' others, among ``count`` fingerprints."""
    total = 0.0
    for bits, t in way:
        spread = 1 << (HAMMING_BITS - 11) if t else 1
        replicas = sum(comb(bits, w) for w in range(t + 2)) / spread if t else 1
        total += REPLICA_COST * replicas + count * replicas * spread / 2.0**bits
    return total


def codes(threshold: int, count: int = 0) -> list[SegmentCode]:
    ways = segmentations(threshold)
    if not ways:
        raise ValueError("the threshold has no covering of 64 bits by codes of this kind")
    out, shift = [], 0
    for number, (bits, t) in enumerate(min(ways, key=lambda w: cost(w, count))):
        out.append(SegmentCode(number, shift, bits, t))
        shift += bits
    return out


def run_links(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between home fingerprints and all others of one anchor."""
    label = np.arange(len(fps))
    at = np.flatnonzero(home)
    for k in range(0, len(at), BLOCK):
        part = at[k : k + BLOCK]
        near = np.bitwise_count(fps[part][:, None] ^ fps[None, :]) <= threshold
        u, v = np.nonzero(near)
        u = part[u]
        while True:
            a, b = label[u], label[v]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def links_at_anchors(cells: DataFrame, threshold: int) -> DataFrame:
    """cells(cell, fp, home), dealt and sorted by cell -> links u, v."""

    def compare(key: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        """Links of whole runs of equal keys; short runs are compared at every distance at once."""
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts = np.r_[0, cuts]
        sizes = np.diff(np.r_[starts, len(key)])
        us, vs = [], []
        small = sizes <= 64
        of = np.repeat(np.arange(len(sizes)), sizes)
        keep = small[of] & (sizes[of] > 1)
        k, f, h = of[keep], fps[keep], home[keep]
        for d in range(1, int(sizes[small].max(initial=0))):
            if d >= len(k):
                break
            at = np.flatnonzero((k[d:] == k[:-d]) & (h[d:] | h[:-d]))
            if not len(at):
                continue
            at = at[np.bitwise_count(f[at] ^ f[at + d]) <= threshold]
            us.append(f[at])
            vs.append(f[at + d])
        for r in np.flatnonzero(~small):
            s, e = starts[r], starts[r] + sizes[r]
            u, v = run_links(fps[s:e], home[s:e], threshold)
            us.append(u)
            vs.append(v)
        pairs = np.stack([np.concatenate(us or [fps[:0]]), np.concatenate(vs or [fps[:0]])], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            part = key, batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[0][0][0] != key[-1]):
                whole = [*held, tuple(x[:cut] for x in part)]
                yield compare(*(np.concatenate(x) for x in zip(*whole)))
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield compare(*(np.concatenate(x) for x in zip(*held)))

    return cells.mapInArrow(run, "u long, v long")


def similar_fingerprints(distinct: DataFrame, threshold: int = 4) -> DataFrame:
    """distinct(fp), each once -> u, v: links between fingerprints at the threshold or closer, enough to connect all."""
    own = codes(threshold, distinct.count())
    # Dealt anew, as Spark may have put few bytes of fingerprints, which become many of replicas, into a task or two.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c.home(fps) for c in own]))], ["anchor"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fps = whole.slice(at, 4096).column(0).to_numpy().view(np.uint64)
                for code in own:
                    anchors, index = code.replicas(fps)
                    home = code.home(fps)[index] == anchors
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors), pa.array(fps[index].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"]
                    )

    hot = distinct.mapInArrow(homes, "anchor long").groupBy("anchor").count().where(F.col("count") > HOT)
    hot = written(hot.select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / HOT).cast("int").alias("side")), "hot")
    rows = distinct.mapInArrow(replicate, "anchor long, fp long, home boolean")
    n = hot.count()
    if n:
        side = F.col("side")
        mine = F.pmod(F.xxhash64("fp"), side)
        every = F.sequence(F.lit(0), side - 1)
        # A home fingerprint is the first of a pair in its own row of the grid, and any is the second in its own column.
        cells = F.concat(
            F.when(F.col("home"), F.transform(every, lambda j: mine * side + j)).otherwise(F.array().cast("array<bigint>")),
            F.transform(every, lambda i: i * side + mine),
        )
        rows = rows.join(F.broadcast(hot) if n <= MOST_BROADCAST else hot, F.col("anchor") == F.col("hot"), "left")
        cool = rows.where("hot is null").select("anchor", "fp", "home")
        warm = rows.where("hot is not null").select("anchor", "fp", "home", F.explode(F.array_distinct(cells)).alias("cell"))
        rows = cool.union(warm.select(F.xxhash64("anchor", "cell").bitwiseOR(F.lit(-(1 << 63))).alias("anchor"), "fp", "home"))
    return links_at_anchors(rows.repartition("anchor").sortWithinPartitions("anchor"), threshold)


def near_duplicates(
    df: DataFrame, words_in: int = 4, threshold: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per row: the id, fp (signed long), root (a fingerprint of the component) and component_id."""
    prints = written(fingerprints(df, words_in, seed, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("__least")), "distinct")
    linked = components(similar_fingerprints(distinct.select("fp"), threshold))
    classes = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    classes = classes.select("fp", F.coalesce("root", "fp").alias("root"), "__least")
    least = classes.groupBy("root").agg(F.min("__least").alias("component_id"))
    # Under a name that Spark does not know to be dealt by root, the join deals both sides anew, so it can split a hot root.
    least = least.select(F.bitwise_not(F.bitwise_not("root")).alias("of"), "component_id")
    classes = classes.select("fp", "root").join(least, F.col("root") == F.col("of")).drop("of")
    return prints.join(classes, "fp").select(id_col, "fp", "root", "component_id")


def keep_one(df: DataFrame, words_in: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the one of the smallest id, a null id coming last.

    Texts that share an id are documents of their own, told apart by a hash of the text; rows alike in both stay once.
    """
    key = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    keyed = df.withColumn("__key", key)
    found = near_duplicates(keyed, words_in, threshold, id_col="__key", text_col=text_col)
    chosen = found.where(F.col("__key").eqNullSafe(F.col("component_id"))).select("__key").distinct()
    return keyed.join(chosen, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
