import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from lodestone.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return Library.from_file(PATH), bpe.Tokenizer.load(PATH)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_equals_the_library(both, spark, sf):
    library, own = both
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(1)
    parts = [*"aaaabAB Σσςİ'’ ǅ½²٣ 漢字́é ​\n\t!?-KKſßẞﬀÅ\x1c\x85\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|endof", "'ll", "I'VE", "\r\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 999, ""]
    for text, got, want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(got) == want.ids, text
        assert own.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_kept_words_are_forgotten(both, monkeypatch):
    _, own = both
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    texts = ["one two three four", "five six", "one two"]
    alone = [next(own.encode_batch([t])) for t in texts]
    assert alone == [next(own.encode_batch([t])) for t in texts]


def test_merges_that_rank_below_their_parts_are_refused():
    alphabet = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    vocab = alphabet | {"ab": 256, "abc": 257}
    spec = {"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}, "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": ".+"}}]}}
    with pytest.raises(ValueError):
        bpe.Tokenizer(spec)


def test_tokenize(both, edge_docs, no_docs):
    library, _ = both
    rows = bpe.tokenize(edge_docs, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.where("doc_id is not null").collect()}
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids"]) == (len(want), want)
    digests = {r["doc_id"]: r for r in bpe.tokenize(edge_docs, PATH, digests=True).collect()}
    assert digests[4]["ids_sha256"] == digests[4]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.tokenize(no_docs, PATH).count() == 0


def test_other_settings_are_refused():
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": {**spec["model"], "dropout": 0.1}}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.Tokenizer({**spec, **change})
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="added_tokens"):
        bpe.Tokenizer(spec)
