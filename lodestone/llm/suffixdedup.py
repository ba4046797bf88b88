"""Removal of repeated byte strings by suffix arrays, over documents of any number.

Each byte that a string of ``length`` bytes covers goes if that string also begins anywhere else. Strings are judged on
the input. A shard's suffix array is built by induced sorting, and its permuted common prefixes tell which starts share
``length`` bytes (suffixes.py). What goes to a shard:

1. Winnowing cuts each text into runs of window starts with the same key, so equal windows have equal keys (winnow.py).
   Rows (text, key, content hash and place of the run) are written once; counts by key, pre-aggregated, find the keys that occur
   twice. All else occurs once and is done with.
2. Texts with such keys are written with the list of these runs. A run whose key has one content only is repeated as a
   whole. The others' bytes go to shards by key; keys of more than ``HOT`` runs go by the hash of a core of the window
   instead, which deals one key's runs over many shards.
3. In a shard, runs are cut into bins by the distance to the key's gram; windows of a bin share a core of bytes. Pieces
   whose core occurs in different surroundings go to the suffix array, which takes pooled pieces; of the others, those
   that occur twice are repeated as a whole.
4. Found starts go back to their texts, and the texts' other bytes are kept, as bytes or their digest and as text.

Defined results: null texts count as empty; texts shorter than ``length`` stay whole; repeated rows are repeats of each
other; a null id is an id. Columns other than those named are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dropped, written
from lodestone.llm.suffixes import shared_starts
from lodestone.llm.winnow import GRAM, MIX, gram_hashes, mixed, segments, substring_hashes, sums_of

#: Window starts of a bin; bytes that a suffix array takes at once; runs of a key from which it is dealt by cores.
BIN, POOL, HOT = 16, 1_500_000, 5_000
#: Bytes of runs that are cut into bins at once.
BATCH = 400_000
#: Bytes of different pieces that a task gathers, and counts, before it sends them.
GATHERED = 16_000_000
#: Kinds of runs: repeated as a whole, to compare by key, to compare by cores.
WHOLE, MIXED, CORES = 0, 1, 2


def runs_of(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Key, first start, last start and content hash (signed) of each run."""
    keys, first, last = segments(np.frombuffer(raw, np.uint8), length)
    digest = xxhash.xxh3_64_intdigest
    held = [digest(raw[i:j]) for i, j in zip(first.tolist(), (last + length).tolist())]
    return keys, first, last, held


@dataclass
class Bins:
    """Window starts that share a core, first to last, by place: the run, its starts, the core's and the piece's hash."""

    run: np.ndarray
    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, contents: list[bytes], keys: np.ndarray, length: int) -> Bins:
        """The bins of runs, which are given by their bytes and their keys."""
        raw = np.frombuffer(b"".join(contents), np.uint8)
        sizes = np.array([len(c) for c in contents])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        sums = sums_of(raw)
        h = gram_hashes(raw, sums=sums)
        at = np.flatnonzero(h == np.repeat(keys, sizes)[: len(h)])
        at = at[at + GRAM <= ends[np.searchsorted(ends, at, side="right")]]
        counts = sizes - length + 1
        run = np.repeat(np.arange(len(contents)), counts)
        starts = np.arange(len(run)) + np.repeat(begins - np.cumsum(counts) + counts, counts)
        # The last gram of the key in the window: the same in equal windows.
        gram = at[np.searchsorted(at, starts + length - GRAM, side="right") - 1]
        number = (gram - starts) // BIN
        new = np.flatnonzero((np.diff(run) != 0) | (np.diff(gram) != 0) | (np.diff(number) != 0)) + 1
        cuts = np.concatenate([[0], new])
        first, last, run = starts[cuts], starts[np.append(new, len(starts)) - 1], run[cuts]
        core = gram[cuts] - number[cuts] * BIN
        what = ((gram[cuts] - first) * 64 + (last - first)).astype(np.uint64)
        piece = mixed(substring_hashes(sums, first, last + length) ^ (what * MIX))
        core = substring_hashes(sums, core, core + length - BIN + 1)
        return cls(run, first - begins[run], last - begins[run], core, piece)


class Shard:
    """Finds repeated starts in runs (name, key, content, count); yields (names, first, last) of them.

    Runs of a key come together, with different contents. Pieces with equal hashes, of 64 bits beside the key's and the
    core's, are equal.
    """

    def __init__(self, length: int):
        self.length = length
        self.held: list[tuple[tuple, int, int, bytes, int]] = []
        self.groups = self.size = 0
        self.pieces: list[tuple[bytes, int, int]] = []
        self.refs: list[tuple[tuple, int] | None] = []
        self.bytes = 0

    def group(self, key: int, runs: list[tuple[tuple, bytes, int]]) -> Iterator[tuple[tuple, int, int]]:
        """runs: (name, content, how often) of one key; a name is what a result is called by."""
        self.held += [(name, key, self.groups, content, count) for name, content, count in runs]
        self.groups += 1
        self.size += sum(len(content) for _, content, _ in runs)
        if self.size >= BATCH:
            yield from self.sort_out()

    def sort_out(self) -> Iterator[tuple[tuple, int, int]]:
        """Compares the pieces of the runs held, and leaves to the suffix array those that stand beside different ones."""
        if not self.held:
            return
        names, keys, groups, contents, counts = zip(*self.held)
        self.held, self.groups, self.size = [], 0, 0
        keys = np.array(keys, np.uint64)
        parts, at = [], 0
        while at < len(contents):
            end, size = at + 1, len(contents[at])
            while end < len(contents) and size < BATCH:
                size += len(contents[end])
                end += 1
            bins = Bins.of(list(contents[at:end]), keys[at:end], self.length)
            bins.run += at
            parts.append(bins)
            at = end
        run, first, last, core, piece = (np.concatenate([getattr(b, f) for b in parts]) for f in ("run", "first", "last", "core", "piece"))
        core = mixed(core ^ (np.array(groups, np.uint64)[run] * MIX))
        order = np.lexsort((piece, core))
        run, first, last, core, piece = (x[order] for x in (run, first, last, core, piece))
        new_core = np.concatenate([[True], core[1:] != core[:-1]])
        new_piece = new_core | np.concatenate([[True], piece[1:] != piece[:-1]])
        of_piece = np.cumsum(new_piece) - 1
        weight = np.bincount(of_piece, np.array(counts, np.float64)[run])
        of_core = (np.cumsum(new_core) - 1)[new_piece]
        several = np.bincount(of_core)[of_core] > 1
        twice = weight >= 2
        where = np.flatnonzero(twice[of_piece])
        yield from zip([names[i] for i in run[where].tolist()], first[where].tolist(), last[where].tolist())
        for i, own in zip(np.flatnonzero(new_piece)[several].tolist(), twice[several].tolist()):
            a, b, r = int(first[i]), int(last[i]), int(run[i])
            self.pieces.append((contents[r][a : b + self.length], b - a + 1, 1 + own))
            self.refs.append(None if own else (names[r], a))
            self.bytes += b - a + self.length
            if self.bytes >= POOL and new_core[i]:
                # The piece just added begins another core.
                kept = self.pieces.pop(), self.refs.pop()
                yield from self.flush()
                self.pieces, self.refs, self.bytes = [kept[0]], [kept[1]], len(kept[0][0])

    def end(self) -> Iterator[tuple[tuple, int, int]]:
        yield from self.sort_out()
        yield from self.flush()

    def flush(self) -> Iterator[tuple[tuple, int, int]]:
        if self.pieces:
            for ref, shared in zip(self.refs, shared_starts(self.pieces, self.length)):
                if ref:
                    edges = np.diff(np.concatenate([[0], shared.astype(np.int8), [0]]))
                    spans = zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist())
                    yield from ((ref[0], ref[1] + a, ref[1] + b) for a, b in spans)
        self.pieces, self.refs, self.bytes = [], [], 0


def kept_bytes(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """What is left without the windows that start in the spans (first, last), and the number of maximal removed runs."""
    out, at, n = [], 0, 0
    end = -1
    for first, last in sorted(spans):
        if first > end:
            out.append(raw[at:first])
            n += 1
        end = max(end, last + length)
        at = end
    return b"".join([*out, raw[at:]]), n


def lists(column: pa.ListArray, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each list of structs of longs or integers, its fields as arrays; none is null."""
    ends = column.offsets.to_numpy()
    fields = [column.values.field(n).to_numpy(zero_copy_only=False) for n in names]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield tuple(f[a:b] for f in fields)


def _row_key(id_col: str, text_col: str) -> list:
    """128 bits that tell rows apart; rows alike in both columns share it, and their results."""
    parts = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")), F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(97), *parts).alias("r2")]


def repeated_spans(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """rows(id, r1, r2, text) -> the rows with whole and runs, what stands of repeated keys, null if nothing does, and
    spans(r1, r2, spans); whole and spans are places."""

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1, r2 = (batch.column(i).to_numpy() for i in (0, 1))
            sizes, keys, places, held = [], [], [], []
            for text in batch.column(2):
                raw = text.as_py().encode("utf-8", "replace")
                k, first, last, c = runs_of(raw, length)
                sizes.append(len(k))
                keys.append(k)
                places.append(first * length + last - first)
                held += c
            if held:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(r1, sizes)),
                        pa.array(np.repeat(r2, sizes)),
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.array(held, np.uint64).view(np.int64)),
                        pa.array(np.concatenate(places)),
                    ],
                    ["r1", "r2", "key", "content", "place"],
                )

    texts = rows.where(F.octet_length("text") >= length).select("r1", "r2", "text")
    runs = written(texts.mapInArrow(winnow, "r1 long, r2 long, key long, content long, place long"), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    keys = keys.where("n > 1").select(
        F.col("key").alias("k"),
        F.when(F.col("low") == F.col("high"), WHOLE).when(F.col("n") > HOT, CORES).otherwise(MIXED).alias("kind"),
    )
    # Written, so that the join deals both sides anew and Spark can split a hot key's runs.
    keys = written(keys, "keys")
    # Of a run that is repeated as a whole its place is enough.
    whole = F.col("kind") == WHOLE
    found = runs.join(keys, F.col("key") == F.col("k")).groupBy("r1", "r2").agg(
        F.collect_set(F.when(whole, F.col("place"))).alias("whole"),
        F.collect_set(F.when(~whole, F.struct("key", "content", "place", (F.col("kind") == CORES).alias("cores")))).alias("runs"),
    )
    rows = written(rows.join(found, ["r1", "r2"], "left"), "texts")
    del found
    dropped(runs, keys)
    texts = rows.where("runs is not null")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs to compare: shard's key, run's key, content's hash, offset of the piece, bytes, how often."""
        out: dict[tuple[int, int, int, int, bytes], int] = {}
        size = 0
        for batch in batches:
            for text, (keys, held, cores, places) in zip(batch.column(0), lists(batch.column(1), ("key", "content", "cores", "place"))):
                if not len(keys):
                    continue
                raw = text.as_py().encode("utf-8", "replace")
                first, more = np.divmod(places, length)
                for key, c, hot, i, j in zip(*(x.tolist() for x in (keys, held, cores, first, first + more))):
                    content = raw[i : j + length]
                    if not hot:
                        pieces = [(key, key, c, 0, content)]
                    else:
                        bins = Bins.of([content], np.array([key % (1 << 64)], np.uint64), length)
                        cut = zip(bins.core.view(np.int64).tolist(), bins.first.tolist(), bins.last.tolist())
                        pieces = [(shard, key, c, a, content[a : b + length]) for shard, a, b in cut]
                    for piece in pieces:
                        size += 0 if piece in out else len(piece[4])
                        out[piece] = out.get(piece, 0) + 1
                if size > GATHERED:
                    yield from _batches(out)
                    out, size = {}, 0
        if out:
            yield from _batches(out)

    def _batches(out: dict) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int64()]
        names = ["shard", "key", "content", "offset", "bytes", "times"]
        rows = [(*piece, n) for piece, n in out.items()]
        for at in range(0, len(rows), 5000):
            cols = list(zip(*rows[at : at + 5000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard's and run's key; each distinct piece once, with how often it came."""
        shard = Shard(length)
        held: dict[tuple[int, int, bytes], int] = {}
        now, out = None, []

        def close() -> None:
            if len(held) > 1 or any(n > 1 for n in held.values()):
                runs = [((now[1], content, offset), raw, n) for (content, offset, raw), n in held.items()]
                for (key, content, offset), a, b in shard.group(now[1] % (1 << 64), runs):
                    out.append((key, content, a + offset, b + offset))

        def give() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "content", "first", "last"])

        for batch in batches:
            for at, key, content, offset, raw, times in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, key) != now:
                    if now is not None:
                        close()
                    held.clear()
                    now = at, key
                what = content, offset, raw
                held[what] = held.get(what, 0) + times
            if out:
                yield give()
        if now is not None:
            close()
        for (key, content, offset), a, b in shard.end():
            out.append((key, content, a + offset, b + offset))
        if out:
            yield give()

    pieces = texts.select("text", "runs").mapInArrow(
        emit, "shard long, key long, content long, offset int, bytes binary, times long"
    )
    starts = pieces.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(
        compare, "key long, content long, first long, last long"
    )
    # A run's starts are relative to it, and one list per run is bounded by its length.
    starts = written(
        starts.groupBy("key", "content").agg(F.collect_set(F.struct("first", "last")).alias("starts")), "starts"
    )
    # Spans as places: first start times the length, and how many starts follow.
    listed = texts.select("r1", "r2", F.inline("runs")).join(starts, ["key", "content"])
    at = F.col("place") - F.col("place") % length
    own = F.transform("starts", lambda s: at + s["first"] * length + s["last"] - s["first"])
    spans = listed.groupBy("r1", "r2").agg(F.flatten(F.collect_set(own)).alias("spans"))
    return rows, spans


def remove_repeats(
    df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """A row per row: the id, n_bytes, n_removed, n_spans, kept (binary), or with digests its SHA-256, n_kept and text.

    text is what is left as text: a character that a cut has broken goes as a whole.
    """
    if length < 2 * GRAM + BIN:
        raise ValueError("length is too small for the grams")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, spans = repeated_spans(df.select(F.col(id_col).alias("id"), *_row_key(id_col, text_col), text.alias("text")), length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept, rest = [], [], [], []
            for text, *found in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = text.as_py().encode("utf-8", "replace")
                places = np.unique(np.array([p for f in found for p in f.as_py() or ()], np.int64))
                first, more = np.divmod(places, length)
                own = list(zip(first.tolist(), (first + more).tolist()))
                left, n = kept_bytes(raw, own, length)
                removed.append(len(raw) - len(left))
                n_spans.append(n)
                kept.append(hashlib.sha256(left).hexdigest() if digests else left)
                rest.append(left.decode("utf-8", "ignore"))
            counts = [pa.array(x, pa.int64()) for x in (removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), *counts, pa.array(kept, pa.string() if digests else pa.binary()), pa.array(rest)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "text"],
            )

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    none = F.lit(0).cast("long")
    raw = F.col("text").cast("binary")
    whole = rows.where("runs is null").select(
        "id", n_bytes, none.alias("n_removed"), none.alias("n_spans"), (F.sha2(raw, 256) if digests else raw).alias("kept"), "text"
    )
    changed = rows.where("runs is not null").join(spans, ["r1", "r2"], "left").select("id", "text", "spans", "whole", n_bytes)
    return whole.union(changed.mapInArrow(apply, whole.schema)).select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.col("kept").alias("kept_sha256" if digests else "kept"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
        "text",
    )
