"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every passage of every document is a query. Passages are windows of words that overlap by half and hold any item whole.
Impacts are divided by the item's score against itself, so one threshold serves all items and an item that a passage
holds whole scores 1. The search gets all items over the threshold. Items stand in blocks by number, and each term has
its greatest impact in each block: a passage's sums of these tell at once which blocks can reach the threshold, mostly
none. There WAND pivots on the terms' upper bounds, checks the block maxima at the pivot, and skips what cannot. Each hit is verified: the passage must hold
``OVERLAP`` of the five-word shingles of the item's question and of its answer. The answer is the item's last sentence,
or the second half of its words if it has just one sentence; a part under five words is one shingle. A part that stands in
one run but for its first or last word is held to the share of its words, so that no edge word of a short part decides; an
item of five words or more is also held where it stands verbatim with its ends inside longer words.

Document frequencies and the mean length are those of all items, and a passage's size goes with the item's class of length
(``SHORT`` words, twice, four times as many and so on), so scores do not depend on how the items are indexed. The index is
built by Spark in blocks of one class, of about ``MOST_ITEMS`` items and ``MOST_CHARS`` code points. One pass over the
documents searches the blocks, each of which is a broadcast of bounded size, in turn; a task holds one block, and
``HELD`` code points of documents if there are more blocks than one.

Defined results: words are runs of letters and digits, case-folded; items without one (null and blank ones are such) match
nothing, nor do such texts; repeated rows and repeated items are reported one by one. Whole texts
are searched. Columns other than those named are dropped; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import sent, written

K1, B, SHINGLE, OVERLAP, THRESHOLD = 1.2, 0.75, 5, 0.8, 0.6
MOST_ITEMS, MOST_CHARS, HELD = 4000, 4_000_000, 8_000_000
#: Words of the shortest class of items.
SHORT = 64
#: Items of a posting block at least, and blocks of an index at most.
LEAST_BLOCK, MOST_BLOCKS = 8, 64
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").casefold())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    found = [w for s in SENTENCE_END.split(text) if (w := words_of(s))]
    if len(found) > 1:
        return [w for s in found[:-1] for w in s], found[-1]
    words = found[0] if found else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """The shingles of n words, or the whole sequence if it is shorter."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def class_of(size: int) -> int:
    """0 for items of up to SHORT words, 1 for up to twice as many, and so on."""
    return max(0, (max(size, 1) - 1) // SHORT).bit_length()


class Index:
    """BM25 postings of items with block maxima; items are (id, text) and known by their places.

    df, count and mean: in how many items the words of these are, how many items there are, and their mean length, if the
    items are a part of all.
    """

    def __init__(self, items: list[tuple[object, str | None]], df: dict[str, int] | None = None, count: int = 0, mean: float = 0.0):
        words = [words_of(t) for _, t in items]
        bags = [Counter(w) for w in words]
        self.texts = [" ".join(w) if len(w) >= SHINGLE else "" for w in words]
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(t or "") for _, t in items]
        sizes = [sum(b.values()) for b in bags]
        if df is None:
            df, count = Counter(w for b in bags for w in b), len(items)
            mean = sum(sizes) / max(1, len(sizes)) or 1.0
        idf = {w: math.log(1 + (count - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.terms = {w: i for i, w in enumerate(df)}
        self.postings: list[list[int]] = [[] for _ in df]
        self.impacts: list[list[float]] = [[] for _ in df]
        for at, (bag, size) in enumerate(zip(bags, sizes)):
            norm = K1 * (1 - B + B * size / mean)
            impact = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in bag.items()}
            # An item of which all but the edge words is there must reach the threshold too.
            whole, inner = sum(impact.values()), sum(impact[w] for w in set(words[at][1:-1]))
            if self.texts[at]:
                whole = min(whole, inner / THRESHOLD)
            for w, x in impact.items():
                self.postings[self.terms[w]].append(at)
                self.impacts[self.terms[w]].append(x / whole)
        self.block = max(LEAST_BLOCK, -(-len(items) // MOST_BLOCKS))
        self.block_max = np.zeros((len(df) + 1, -(-len(items) // self.block) or 1), np.float32)
        for t, (p, x) in enumerate(zip(self.postings, self.impacts)):
            np.maximum.at(self.block_max[t], np.array(p) // self.block, np.nextafter(np.array(x, np.float32), np.float32(2)))
        self.bound = np.array([max(x) for x in self.impacts] + [0.0])
        self.passage = 2 * SHORT << class_of(max(sizes, default=0))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Places and scores of the items that score at least the threshold against distinct terms, by block-max WAND."""
        most = self.block_max[terms].sum(axis=0, dtype=np.float64)
        out: list[tuple[int, float]] = []
        if most.max() >= threshold:
            for block in np.flatnonzero(most >= threshold - 1e-9).tolist():
                out += self.search_block(terms, block, threshold)
        return out

    def search_block(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """WAND in one block, with the block's maxima as the terms' bounds."""
        out = []
        first, end = block * self.block, (block + 1) * self.block
        bound = self.block_max[:, block]
        cursors = []  # item, term, place in the term's postings
        for t in terms[bound[terms] > 0].tolist():
            at = bisect_left(self.postings[t], first)
            cursors.append([self.postings[t][at], t, at])
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += bound[c[1]]
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            to = item
            if cursors[0][0] == item:
                score = sum(self.impacts[t][at] for _, t, at in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    out.append((item, score))
                to = item + 1
            moved = []
            for _, t, at in cursors[: pivot + 1]:
                p = self.postings[t]
                at = bisect_left(p, to, at)
                if at < len(p) and p[at] < end:
                    moved.append([p[at], t, at])
            cursors[: pivot + 1] = moved
        return out

    def verify(self, item: int, words: list[str]) -> tuple[float, float]:
        """The shares of the item's question and answer that the words hold; 1 for an empty part."""
        text = f" {' '.join(words)} "
        if self.texts[item] and self.texts[item] in text:
            return 1.0, 1.0
        shares = []
        for part in self.parts[item]:
            own = shingles(part)
            there = shingles(words, min(SHINGLE, len(part))) if own else set()
            share = sum(s in there for s in own) / len(own) if own else 1.0
            if share < OVERLAP and any(f" {' '.join(run)} " in text for run in (part[1:], part[:-1])):
                share = max(share, (len(part) - 1) / len(part))
            shares.append(share)
        return shares[0], shares[1]


class Searcher:
    """Searches texts against an index."""

    def __init__(self, index: Index):
        self.index = index

    def leaks(self, every: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, list[float]]:
        """For each verified item its best score, question share, answer share, and the number of passages."""
        ids = np.fromiter(map(self.index.terms.get, every, repeat(-1)), np.int64, len(every))
        n, size, step = len(ids), self.index.passage, self.index.passage // 2
        sums = np.concatenate([[0.0], np.cumsum(self.index.bound[ids])])  # bound[-1] is 0
        starts = np.arange(0, max(1, n - size + step), step)
        ends = np.minimum(starts + size, n)
        found: dict[int, list[float]] = {}
        for a, b in zip(starts, ends):
            if sums[b] - sums[a] < threshold - 1e-9:
                continue
            terms = np.unique(ids[a:b])
            terms = terms[terms >= 0]
            words = None
            for item, score in self.index.search(terms, threshold):
                words = words or every[a:b]
                q, r = self.index.verify(item, words)
                if q >= overlap and r >= overlap:
                    best = found.setdefault(item, [0.0, 0.0, 0.0, 0])
                    best[:] = [max(best[0], min(1.0, score)), max(best[1], q), max(best[2], r), best[3] + 1]
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[Callable[[], Index]]:
    """Loaders of the indexes of the items in bounded blocks. Spark builds them; one at a time is on the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(2)]
            sizes = [len(w) for w in words]
            kinds = pa.int64(), pa.int32(), pa.list_(pa.string())
            more = [pa.array(c, k) for c, k in zip((sizes, map(class_of, sizes), [sorted(set(w)) for w in words]), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["n", "id", "text", "size", "class", "terms"])

    texts = items.where(F.length(F.trim(text_col)) > 0)
    rows = texts.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = written(rows.mapInArrow(read, f"n long, id {kind}, text string, size long, class int, terms array<string>"), "items")
    rows = rows.where("size > 0")
    total = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.sum(F.length("text")).alias("chars")).first()
    if not total["n"]:
        return []
    count, mean = total["n"], float(total["mean"])
    blocks = max(-(-count // MOST_ITEMS), -(-total["chars"] // MOST_CHARS))
    each = rows.select("n", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    own = each.join(df, "term").groupBy("n").agg(F.collect_list("term").alias("words"), F.collect_list("df").alias("dfs"))
    whole = rows.drop("terms").join(own, "n").withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        known = {w: n for words, dfs in zip(part["words"], part["dfs"]) for w, n in zip(words, dfs)}
        # Items in the order of their numbers, words in the order of the items: the same index each time.
        index = Index(list(zip(part["id"].tolist(), part["text"].tolist())), dict(sorted(known.items())), count, mean)
        return pd.DataFrame({"index": [cloudpickle.dumps(index)]})

    made = whole.select("n", "id", "text", "class", "block", "words", "dfs").groupBy("class", "block").applyInPandas(build, "index binary")
    return [sent(items.sparkSession, bytes(r["index"])) for r in made.toLocalIterator()]


def searched(blocks: list[Callable[[], Index]], groups: Iterator[list[str | None]]) -> Iterator[list[list[tuple]]]:
    """For each group of texts, the leaks of each text as (item's id, score, question and answer share, passages)."""
    one = Searcher(blocks[0]()) if len(blocks) == 1 else None
    for texts in groups:
        words = [words_of(t) for t in texts]
        found: list[list[tuple]] = [[] for _ in texts]
        for load in blocks:
            searcher = one or Searcher(load())
            for out, every in zip(found, words):
                out += [(searcher.index.ids[item], *got) for item, got in sorted(searcher.leaks(every).items())]
        yield found


def grouped(batches: Iterator[pa.RecordBatch], at: int, held: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches, as many together as have ``held`` code points in the column at a place."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += pc.sum(pc.utf8_length(batch.column(at))).as_py() or 0
        if size >= held:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """A row for each document and item that it leaks: id, item_id, score, question and answer share, passages."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType
    item_type = to_arrow_type(item_kind)
    names = [id_col, "item_id", "score", "question_overlap", "answer_overlap", "passages"]
    schema = f"`{id_col}` {kind}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double, passages long"
    blocks = item_blocks(items, item_col, text_col)
    if not blocks:
        return docs.sparkSession.createDataFrame([], schema)
    held = HELD if len(blocks) > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[pa.RecordBatch]] = []

        def texts() -> Iterator[list[str | None]]:
            for group in grouped(batches, 1, held):
                waiting.append(group)
                yield [t for batch in group for t in batch.column(1).to_pylist()]

        for found in searched(blocks, texts()):
            ids = pa.chunked_array([batch.column(0) for batch in waiting.pop()]).combine_chunks()
            rows = [(i, *row) for i, got in enumerate(found) for row in got]
            if rows:
                at, items_, *shares, passages = zip(*rows)
                own = ids.take(pa.array(at))
                own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
                cols = [own, pa.array(items_, item_type), *(pa.array(c, pa.float64()) for c in shares), pa.array(passages, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs that leak no item, all columns."""
    at = docs.columns.index(text_col)
    blocks = item_blocks(items, item_col, text_col)
    if not blocks:
        return docs
    held = HELD if len(blocks) > 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[pa.RecordBatch]] = []

        def texts() -> Iterator[list[str | None]]:
            for group in grouped(batches, at, held):
                waiting.append(group)
                yield [t for batch in group for t in batch.column(at).to_pylist()]

        for found in searched(blocks, texts()):
            first = 0
            for batch in waiting.pop():
                yield batch.filter(pa.array([not got for got in found[first : first + batch.num_rows]], pa.bool_()))
                first += batch.num_rows

    return docs.mapInArrow(run, docs.schema)
