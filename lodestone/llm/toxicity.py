"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the sum of its distinct words'
weights (hashed: the word, its first four and five letters, its last four); the document's is the noisy-or of its sentences',
1 - prod(1 - p). Only documents are labelled: the noisy-or's likelihood passes the label's gradient on to the sentences
that explain it. The same sentence scores then locate what offends.

A bucket takes part whose documents lean to label 1 by ``ASSOCIATED`` standard deviations.

The fit takes a hash sample of about ``FIT_DOCS`` labelled documents of each label, weighted back to the labels' shares,
and runs in numpy on the driver. Of a text of more than ``FIT_CHARS`` code points it takes as many of its sentences, from
all over it, chosen by their hash. Scoring reads whole texts, however long.

Defined results: a null or empty text has no sentence and score 0; repeated rows are scored alike; without labels of
both kinds every score is 0. Columns other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shipped

BUCKETS = 1 << 18
FIT_DOCS, FIT_CHARS = 3000, 40_000
EPOCHS, BATCH, RATE, DECAY, START = 8, 32, 1.0, 1e-5, -6.0
#: Adagrad's first sum of squares; how far, in standard deviations, a bucket's documents must lean to label 1, and how many
#: of these must have it.
FIRST, ASSOCIATED, LEAST_SEEN = 1e-2, 3.0, 2
KEPT_PIECES = 400_000
SENTENCE = re.compile(r"[.!?;\n]+")
EDGES = ".,;:!?\"'()[]{}<>*_-|#…«»„“”‘’¿¡"


def features(piece: str) -> list[int]:
    """The buckets of a part between spaces, in lower case."""
    word = piece.strip(EDGES)
    if not word:
        return []
    marked = ["=" + word, "4" + word[:4], "5" + word[:5], "-" + word[-4:]]
    return [zlib.crc32(m.encode("utf-8", "replace")) % BUCKETS for m in marked]


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence with anything in it."""
    at = 0
    for m in SENTENCE.finditer(text or ""):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text and text[at:].strip():
        yield at, len(text)


def shortened(text: str, most: int = FIT_CHARS) -> str:
    """The text, or if it is longer than ``most`` sentences of it, chosen by hash, of about so many code points."""
    if len(text) <= most:
        return text
    at = sorted(sentences(text), key=lambda x: zlib.crc32(text[x[0] : x[1]].encode("utf-8", "replace")))
    ends = np.cumsum([e - s for s, e in at])
    return "\n".join(text[s:e][:most] for s, e in sorted(at[: max(1, int(np.searchsorted(ends, most)))]))


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def scorer(self):
        """A function from a sentence, in lower case, to its probability."""
        known: dict[str, float] = {}
        weights, offset = self.weights, self.offset

        def weight(piece: str) -> float:
            w = known[piece] = float(weights[features(piece)].sum())
            return w

        def score(sentence: str) -> float:
            z = offset
            for p in set(sentence.split()):
                w = known.get(p)
                z += weight(p) if w is None else w
            if len(known) > KEPT_PIECES:
                known.clear()
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


def train(bags: list[list[list[int]]], y: np.ndarray, share: np.ndarray, seed: int = 7) -> Model:
    """bags: for each document the buckets of each sentence; share: the documents' weights."""
    rng = np.random.default_rng(seed)
    theta, offset = np.zeros(BUCKETS), START
    squares, offset_squares = np.full(BUCKETS, FIRST), FIRST
    # What does not lean to a label could only be learnt by heart, least of all from few documents.
    seen = np.zeros((2, BUCKETS))
    for b, label in zip(bags, y):
        seen[int(label), list({i for s in b for i in s})] += 1
    positive, count = y.sum(), len(y)
    rate = seen.sum(axis=0) / count
    spread = np.sqrt(np.maximum(positive * (1 - positive / count) * rate * (1 - rate), 1e-9))
    leaning = ((seen[1] - positive * rate) / spread >= ASSOCIATED) & (seen[1] >= LEAST_SEEN)
    bags = [[[i for i in s if leaning[i]] for s in b] for b in bags]
    flat = [(np.array([i for s in b for i in s], np.int64), np.array([len(s) for s in b], np.int64)) for b in bags]
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            ids = np.concatenate([flat[i][0] for i in part])
            sizes = np.concatenate([flat[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(flat[i][1]) for i in part])
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            z = offset + np.bincount(sentence, theta[ids], len(sizes))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            whole = -np.expm1(np.bincount(of, np.log1p(-p), len(part)))
            slope = share[part] * (1 - y[part] / np.maximum(whole, 1e-9))
            back = p * slope[of]
            grad = np.bincount(ids, back[sentence], BUCKETS) / len(part)
            touched = np.unique(ids)
            g = grad[touched] + DECAY * theta[touched]
            squares[touched] += g * g
            theta[touched] -= RATE * g / np.sqrt(squares[touched])
            g0 = back.sum() / len(part)
            offset_squares += g0 * g0
            offset -= RATE * g0 / math.sqrt(offset_squares)
    return Model(theta.astype(np.float32), float(offset))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most: int = FIT_DOCS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model of the documents that have a label 0 or 1 and a text. The ids only join and sample."""
    ready = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    found = {r["label"]: r["count"] for r in ready.groupBy("label").count().collect()}
    if len(found) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -1000.0)
    key = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20))
    least = F.when(F.col("label") == 1, int((1 << 20) * min(1, most / found[1])) + 1).otherwise(
        int((1 << 20) * min(1, most / found[0])) + 1
    )
    # About 2 * most rows, whatever the input's size.
    sample = F.broadcast(ready.where(key < least))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shortened(t) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["text", "label"])

    rows = texts.join(sample, id_col).select("text", "label").mapInArrow(shorten, "text string, label int")
    rows = rows.toPandas().sort_values(["text", "label"])
    kept: dict[str, list[int]] = {}
    bags = []
    for text in rows["text"]:
        low, bag = text.lower(), []
        for s, e in sentences(low):
            ids: list[int] = []
            for p in set(low[s:e].split()):
                if p not in kept:
                    kept[p] = features(p)
                ids += kept[p]
            if ids:
                bag.append(ids)
        bags.append(bag)
    y = rows["label"].to_numpy(np.float64)
    use = np.array([len(b) > 0 for b in bags], bool)
    if not (use & (y == 1)).any() or not (use & (y == 0)).any():
        return Model(np.zeros(BUCKETS, np.float32), -1000.0)
    share = np.where(y == 1, found[1] / max(1, (y == 1).sum()), found[0] / max(1, (y == 0).sum()))
    at = np.flatnonzero(use)
    share = share[at] / share[at].mean()
    return train([bags[i] for i in at], y[at], share, seed)


def score_toxicity(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", offending: float = 0.5
) -> DataFrame:
    """A row per row: the id, score (0 to 1), and sentences: those of at least ``offending``, array of start, end, p."""
    sent = shipped(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent().scorer()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            scores, where = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                free, found = 0.0, []
                for s, e in sentences(text):
                    p = score(text[s:e].lower())
                    free += math.log1p(-min(p, 1 - 1e-12))
                    if p >= offending:
                        found.append({"start": s, "end": e, "p": p})
                scores.append(0.0 - math.expm1(free))
                where.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(where, kind)], [id_col, "score", "sentences"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, sentences array<struct<start:int,end:int,p:double>>"
    return df.select(id_col, text_col).mapInArrow(run, schema)
