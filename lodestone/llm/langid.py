"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's words are lower-cased runs of letters; a word's subwords are its character n-grams, with marks for its ends,
and itself, hashed into ``BUCKETS`` embeddings. The mean of a text's embeddings goes into a linear softmax; embeddings
and softmax are trained by stochastic gradient descent in numpy on the driver. The fit takes a hash sample of about
``FIT_DOCS`` labelled documents, as many of each language, equal texts once: their whole texts, as counts of subwords, and
``SPANS`` spans of at most ``SPAN_WORDS`` words of each, so that short texts are learnt, too. A fifth of them are held
back to calibrate by their spans: a temperature by likelihood, and two bars under which a text is rejected. One is on the score, so that
``REJECTED`` of the calibration texts fall under it, but never over ``MOST_REJECT`` times what a guess among the languages
would score: a text that mixes two of them is told as the likelier one, and kept. The other is on the familiarity, the mean
over the text's subwords of their log frequency in the language that has them most, as far from the held-back spans' median as
is usual for so many subwords, repeated words counting once. It lies midway between the held-back spans' lowest ``REJECTED`` and the highest of the same
spans with their letters dealt anew, or at the former where these overlap. Texts in a language not learnt and gibberish fall
under it, mixtures do not.

The model is linear before the softmax, so each subword's contribution to the classes is one row of a table, and a word's
sum of rows is kept; whole texts are scored, however long.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; ties go to the language
that sorts first; with no labelled document every text is ``und``. A null id counts as empty text for the fold. Columns
other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shipped

BUCKET_BITS, DIM, GRAMS = 16, 16, (2, 3, 4)
BUCKETS = 1 << BUCKET_BITS
#: Odd multipliers of the subwords' polynomial hash.
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
FIT_DOCS, SPAN_WORDS, SPANS = 4000, 96, 3
EPOCHS, STEPS, BATCH, RATE = 6, 1500, 32, 4.0
REJECTED, MOST_REJECT = 0.001, 1.25
#: Count added to each bucket for the familiarity, and its variances at least.
SMOOTH, LEAST_VAR = 0.5, 1e-4
KEPT_PIECES, STEP = 300_000, 1000
LETTERS = regex.compile(r"\p{L}+")
#: Words of a text that are hashed at once.
WORDS = 20_000
UNKNOWN = "und"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the subwords of all words, in lower case, and the index of the word of each."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    power = np.cumprod(np.full(max(int(sizes.max()), *GRAMS), BASE, np.uint64))
    ids = [np.add.reduceat(code * power[np.arange(len(code)) - starts[of]], starts)]
    index = [np.arange(len(words))]
    for n in GRAMS:
        if len(code) < n:
            continue
        last = len(code) - n + 1
        whole = np.flatnonzero(of[:last] == of[n - 1 :])
        ids.append(sum(code[whole + j] * power[j] for j in range(n)) + np.uint64(n))
        index.append(of[whole])
    mixed = np.concatenate(ids) * MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(index)


class Sums:
    """For parts between spaces, the sum of their subwords' rows of a table, and how many these are."""

    def __init__(self, classes: int):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, classes + 2))

    def add(self, table: np.ndarray, pieces: list[str]) -> None:
        if not pieces:
            return
        words = [LETTERS.findall(p) for p in pieces]
        ids, index = subwords([w for found in words for w in found])
        of = np.repeat(np.arange(len(pieces)), [len(found) for found in words])[index]
        new = [np.bincount(of, table[ids, c], len(pieces)) for c in range(table.shape[1])]
        new.append(np.bincount(of, minlength=len(pieces)))
        self.at.update(zip(pieces, range(len(self.sums), len(self.sums) + len(pieces))))
        self.sums = np.concatenate([self.sums, np.stack(new, axis=1)])

    def shrink(self) -> None:
        """Forgets all if there are more than KEPT_PIECES."""
        if len(self.sums) > KEPT_PIECES:
            self.at.clear()
            self.sums = self.sums[:0]


@dataclass
class Model:
    """languages, the contribution of each bucket to each and its familiarity (BUCKETS x languages + 1), offsets,
    temperature, least score, the mean familiarity, its variances between texts and of a subword, its least deviation."""

    languages: list[str]
    table: np.ndarray
    offset: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0
    usual: tuple[float, float, float] = (0.0, 1.0, 0.0)
    strange: float = -np.inf

    def logits(self, texts: list[str | None], known: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The classes' logits of each text, its familiarity, and its number of subwords, 0 if it has no letter."""
        split = [(t or "").lower().split() for t in texts]
        known.add(self.table, list({p for pieces in split for p in pieces if p not in known.at}))
        out = np.zeros((len(texts), len(self.languages) + 2))
        place, sums = known.at.__getitem__, known.sums
        for i, pieces in enumerate(split):
            if pieces:
                out[i] = sums[np.fromiter(map(place, pieces), np.int64, len(pieces))].sum(axis=0)
        n = out[:, -1]
        means = out[:, :-1] / np.maximum(n, 1)[:, None]
        return means[:, :-1] + self.offset, means[:, -1], n

    def deviation(self, familiar: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the familiarity of texts of n subwords is from the usual, in standard deviations."""
        mean, between, within = self.usual
        return (familiar - mean) / np.sqrt(between + within / np.maximum(n, 1))

    def judge(self, texts: list[str | None], known: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best class, its score, whether the text has a letter, and whether it is rejected."""
        logits, familiar, n = self.logits(texts, known)
        best, score = self.predict(logits)
        real = n > 0
        strange = np.flatnonzero(real & (self.deviation(familiar, n) < self.strange))
        # A word said over and over tells no more than once.
        once = [" ".join(dict.fromkeys((texts[i] or "").lower().split())) for i in strange.tolist()]
        _, familiar, n = self.logits(once, known)
        rejected = ~real | (score < self.reject)
        rejected[strange] |= self.deviation(familiar, n) < self.strange
        return best, score, real, rejected

    def predict(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best class and its calibrated probability."""
        z = logits / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = logits.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's subwords, and how often each comes."""
    words = LETTERS.findall(text.lower())
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(words), WORDS):
        total += np.bincount(subwords(words[at : at + WORDS])[0], minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def train(spans: list[tuple[str, str]], whole: Iterable[tuple[str, np.ndarray, np.ndarray]] = (), seed: int = 7) -> Model:
    """A model of (language, text) spans and (language, buckets, counts) of texts, without calibration."""
    whole = list(whole)
    languages = sorted({lang for lang, _ in spans} | {lang for lang, _, _ in whole})
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    bags, ys = [], []
    for lang, text in spans:
        ids, _ = subwords(LETTERS.findall(text.lower()))
        if len(ids):
            ids, counts = np.unique(ids, return_counts=True)
            bags.append((ids.astype(np.uint16), counts.astype(np.float32)))
            ys.append(number[lang])
    for lang, ids, counts in whole:
        if len(ids):
            bags.append((ids, counts))
            ys.append(number[lang])
    y = np.array(ys, np.int64)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, offset = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    # Few documents are gone over more often, so that they are learnt as well as many.
    rounds = -(-len(bags) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // max(1, rounds)))
    steps, step = max(1, epochs * rounds), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            ids = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in part]).astype(np.float32)
            cuts = np.cumsum([0, *(len(bags[i][0]) for i in part)])[:-1]
            mean = np.add.reduceat(embed[ids] * share[:, None], cuts, axis=0)
            z = mean @ weight + offset
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ weight.T
            weight -= rate * mean.T @ p
            offset -= rate * p.sum(axis=0)
            sizes = np.diff(np.r_[cuts, len(ids)])
            np.add.at(embed, ids, -rate * share[:, None] * np.repeat(back, sizes, axis=0))
    seen = np.zeros((len(languages), BUCKETS))
    for (ids, counts), k in zip(bags, ys):
        seen[k, ids] += counts
    familiar = np.log((seen + SMOOTH) / (seen.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).max(axis=0) if languages else np.zeros(BUCKETS)
    return Model(languages, np.column_stack([embed @ weight, familiar.astype(np.float32)]), offset)


def dealt_anew(texts: list[str], seed: int = 7) -> list[str]:
    """The texts with the letters of all dealt over their words: gibberish of the same lengths."""
    rng = np.random.default_rng(seed)
    words = [LETTERS.findall(t.lower()) for t in texts]
    letters = iter(rng.permutation(list("".join(w for found in words for w in found))).tolist())
    return [" ".join("".join(next(letters) for _ in w) for w in found) for found in words]


def calibrate(model: Model, spans: list[tuple[str, str]]) -> Model:
    """Sets the temperature and the score of rejection by held-back spans."""
    spans = [s for s in spans if s[0] in model.languages]
    if not spans:
        return model
    logits, familiar, n = model.logits([t for _, t in spans], Sums(len(model.languages)))
    real = n > 0
    if not real.any():
        return model
    y = np.array([model.languages.index(lang) for lang, _ in spans])[real]
    logits = logits[real]

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(axis=1)
        return float((np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    _, score = model.predict(logits)
    model.reject = float(min(MOST_REJECT / len(model.languages), np.quantile(score, REJECTED)))
    # The variance of a mean of n subwords is that between texts and a share of that within: a line over 1 / n.
    off = (familiar[real] - np.median(familiar[real])) ** 2
    within, between = np.polyfit(1 / n[real], off, 1, w=n[real]) if len(set(n[real])) > 1 else (0.0, off.mean())
    model.usual = (float(np.median(familiar[real])), max(float(between), LEAST_VAR), max(float(within), LEAST_VAR))
    _, odd, m = model.logits(dealt_anew([t for _, t in spans]), Sums(len(model.languages)))
    low = float(np.quantile(model.deviation(familiar, n)[real], REJECTED))
    high = float(np.quantile(model.deviation(odd, m)[real], 1 - REJECTED))
    model.strange = (low + high) / 2 if high < low else low
    return model


def fit(
    df: DataFrame, docs: int = FIT_DOCS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """A calibrated model of the labelled rows of df; rows without a label are left out. The text's hash samples."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    key = F.xxhash64("text", F.lit(seed))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0, np.float32))
    parts = 1 << 30
    share = {lang: int(parts * min(1.0, docs / len(sizes) / max(n, 1))) for lang, n in sizes.items()}
    bar = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
    # Equal texts share a hash: each comes once, however many copies there are.
    labelled = labelled.where(F.pmod(key, F.lit(parts)) <= bar).dropDuplicates(["lang", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document its counts of subwords, and spans, the longest first, at places that its key tells."""
        for batch in batches:
            out: list[tuple] = []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                key = zlib.crc32(text.encode("utf-8", "replace"))
                words, rng = text.split(), np.random.default_rng(key)
                spans = []
                for i in range(SPANS):
                    size = SPAN_WORDS >> (2 * i)
                    at = int(rng.integers(0, max(1, len(words) - size + 1)))
                    spans.append(" ".join(words[at : at + size])[: 32 * SPAN_WORDS])
                ids, counts = bag(text)
                out.append((lang, spans, key, ids.astype("<u2").tobytes(), counts.astype("<f4").tobytes()))
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary()]
            cols = list(zip(*out)) if out else [()] * len(kinds)
            names = ["lang", "spans", "key", "ids", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    # To the driver go the counts of about ``docs`` texts, six bytes for each of a text's subwords, BUCKETS at most, and
    # their spans.
    got = labelled.mapInArrow(cut, "lang string, spans array<string>, key long, ids binary, counts binary").toArrow().to_pylist()
    got = sorted(got, key=lambda r: (r["key"], r["lang"], r["spans"]))
    # Copies of a text share its key, so they never stand on both sides.
    fitted, held = [r for r in got if r["key"] % 5], [r for r in got if r["key"] % 5 == 0]
    if not fitted:
        fitted, held = held, []
    spans = [(r["lang"], t) for r in fitted for t in r["spans"]]
    whole = [(r["lang"], np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["counts"], "<f4")) for r in fitted]
    return calibrate(train(spans, whole, seed), [(r["lang"], t) for r in held for t in r["spans"]])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: the id, lang_pred, score and rejected."""
    sent = shipped(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        known = Sums(len(model.languages))
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                known.shrink()
                batch = whole.slice(at, STEP)
                if model.languages:
                    best, score, real, rejected = model.judge(batch.column(1).to_pylist(), known)
                else:
                    real, rejected = np.zeros(batch.num_rows, bool), np.ones(batch.num_rows, bool)
                    best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                names = [model.languages[b] if r else UNKNOWN for b, r in zip(best.tolist(), real.tolist())]
                score = np.where(real, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    [id_col, "lang_pred", "score", "rejected"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose text the model does not reject, all columns."""
    sent = shipped(df.sparkSession, model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        known = Sums(len(model.languages))
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                known.shrink()
                batch = whole.slice(start, STEP)
                if model.languages:
                    rejected = model.judge(batch.column(at).to_pylist(), known)[-1]
                    yield batch.filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)
