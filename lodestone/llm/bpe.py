"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch are laid out as one array of symbols with links to the next and the previous one. An index maps
each mergeable pair's rank to the positions where the pair occurs in the whole batch. Active ranks are applied in
ascending order, each to all its positions at once; the neighbours' new pairs enter the index, the old ones are found
stale when their rank comes. The words' ids are kept, so each word is merged once for each batch of texts.

Applying a rank everywhere before any other equals the usual order, lowest rank first and leftmost first in each word,
since no pair that holds a merge's product ranks below that merge; ``load`` checks this of the vocabulary.

Defined results: a null text counts as empty; empty texts have no ids; whole texts are encoded, however long. Only the
columns named are read, so others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Code points of texts that are encoded together, and parts between spaces whose ids are kept from one batch to the next.
BATCH_CHARS, KEPT_PIECES = 6_000_000, 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


#: What a vocabulary file may ask for: other settings would be encoded wrongly.
SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "post_processor": None,
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": ..., "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": ..., "use_regex": False},
        ],
    },
    "added_tokens": [{"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}],
}


def differences(wanted: object, got: object, at: str = "") -> list[str]:
    """Where settings are not as wanted; ... stands for any, and the one entry of added_tokens for each."""
    if wanted is ...:
        return []
    if isinstance(wanted, dict) and isinstance(got, dict):
        return [d for k, v in wanted.items() for d in differences(v, got.get(k) or (None if v is None else got.get(k)), f"{at}/{k}")]
    if isinstance(wanted, list) and isinstance(got, list):
        if at == "/added_tokens":
            wanted = wanted * len(got)
        if len(wanted) == len(got):
            return [d for i, (v, w) in enumerate(zip(wanted, got)) for d in differences(v, w, f"{at}/{i}")]
    return [] if (wanted or None) == (got or None) else [at]


class Tokenizer:
    """A byte-level BPE vocabulary with word ends, in the tokenizers library's JSON format; refuses other settings."""

    def __init__(self, spec: dict):
        if odd := differences(SETTINGS, {"added_tokens": [], **spec}):
            raise ValueError(f"this vocabulary file has settings that are not supported: {', '.join(odd)}")
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.table = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.base = left, right, len(self.table)
        made = {}
        for rank, p in enumerate(self.product.tolist()):
            made[p] = rank
        if any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist()))):
            raise ValueError("a merge of this vocabulary ranks below one that makes its part")
        keys = left * self.base + right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(patterns[0])
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.ids: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case of each character by itself (white space never reaches a word)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The text's parts between spaces and line ends, which no word reaches across; special tokens stand alone."""
        if self.special_at is None or not self.special_at.search(text):
            return self.normal(text).replace("\n", " ").split(" ")
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [*self.normal(text[at : m.start()]).replace("\n", " ").split(" "), m[0]]
            at = m.end()
        return out + self.normal(text[at:]).replace("\n", " ").split(" ")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        coded = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(c) for c in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[raw]
        sym[ends] = self.final[raw[ends]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the index."""
            at = at[after[at] >= 0]
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            groups = index.pop(r)
            # A position may stand in it twice; merging it twice at once is merging it once.
            at = groups[0] if len(groups) == 1 else np.concatenate(groups)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:
                # In a chain of equal symbols every other pair is merged, from the left.
                at = np.unique(at)
                taken, free = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != free:
                        taken.append(p)
                        free = q
                    else:
                        free = -1
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.product[r]
            alive[gone] = False
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at]))
        word = np.repeat(np.arange(len(words)), sizes)[alive]
        stops = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        flat = sym[alive].astype("<u4").tobytes()
        return [flat[i:j] for i, j in zip([0, *stops], stops)]

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.ids) > KEPT_PIECES:
            self.ids.clear()
        known = self.ids
        new = {p for pieces in split for p in pieces if p not in known}
        for p in new & self.special.keys():
            known[p] = np.array([self.special[p]], "<u4").tobytes()
        words = {p: self.word.findall(p) for p in new - self.special.keys()}
        distinct = list({w for found in words.values() for w in found})
        if distinct:
            merged = dict(zip(distinct, self.merge(distinct)))
            known.update({p: b"".join([merged[w] for w in found]) for p, found in words.items()})
        else:
            known.update(dict.fromkeys(words, b""))
        for pieces in split:
            yield b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes | list[int]) -> str:
        """The tokens of the ids, joined as the library does without a decoder."""
        flat = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        table = self.table
        return " ".join([table[i] for i in flat])


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` characters in the column, one row at least."""
    for batch in batches:
        sizes = np.diff(np.array(pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist(), np.int64).cumsum(), prepend=0)
        at = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def tokenize(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """A row per row: the id, n_tokens, and ids (array of integers) and decoded text, or with digests their SHA-256.

    path: the vocabulary file, which every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.load(path)
        for batch in chunks(batches, 1, BATCH_CHARS):
            sizes, ids, decoded = [], [], []
            for one in tokenizer.encode_batch(batch.column(1).to_pylist()):
                sizes.append(len(one) // 4)
                back = tokenizer.decode(one)
                if digests:
                    ids.append(hashlib.sha256(one).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                else:
                    ids.append(np.frombuffer(one, "<u4").astype(np.int32))
                    decoded.append(back)
            made = [pa.array(sizes, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [id_col, *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = ["long", "string", "string"] if digests else ["long", "array<int>", "string"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} {k}" for n, k in zip(names, kinds))])
    return df.select(id_col, text_col).mapInArrow(run, schema)
