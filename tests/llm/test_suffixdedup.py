import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import suffixdedup, suffixes
from lodestone.llm.winnow import segments


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, digest, bytes left, text left) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), len(kept), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize("small", [1024, 2])
def test_suffix_arrays(monkeypatch, small):
    """Both ways to induce, against sorting."""
    monkeypatch.setattr(suffixes, "SMALL", small)
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 80)))
        t = s.tolist()
        sa = suffixes.suffix_array(s)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        plcp = suffixes.common_prefixes(s, sa, np.array([0]), 500)
        for a, b in zip(sa[:-1], sa[1:]):
            n = 0
            while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert plcp[b] == n
    assert suffixes.suffix_array(np.zeros(0, np.int64)).tolist() == []


def test_equal_windows_share_a_key_and_no_run():
    rng = random.Random(2)
    line = bytes(rng.choice(b"abcd") for _ in range(70))
    raw = bytes(rng.choice(b"abcd") for _ in range(300)) + line * 6 + b"xyz" * 200 + line * 3 + b"a" * 500
    length = 80
    keys, first, last = segments(np.frombuffer(raw, np.uint8), length)
    assert first[0] == 0 and last[-1] == len(raw) - length and (first[1:] == last[:-1] + 1).all()
    where = {}
    for run, (k, i, j) in enumerate(zip(keys.tolist(), first.tolist(), last.tolist())):
        for s in range(i, j + 1):
            where.setdefault(raw[s : s + length], []).append((k, run))
    for met in where.values():
        assert len({k for k, _ in met}) == 1 and len({r for _, r in met}) == len(met)


@pytest.mark.parametrize(("hot", "pool"), [(suffixdedup.HOT, suffixdedup.POOL), (2, 2000)])
def test_matches_brute_force(spark, monkeypatch, hot, pool):
    """Copies, near copies, shared passages, lines repeated in a text, and boundaries; also with hot keys and small pools."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "POOL", pool)
    rng = random.Random(3)
    length = 60
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.5:
            p = rng.choice(passage)
            cut = rng.randint(0, 30)
            body.insert(rng.randint(0, len(body)), p[cut : len(p) - rng.randint(0, 40)])
        texts.append(" ".join(body))
    for _ in range(20):
        t = rng.choice(texts)
        at = rng.randint(0, len(t))
        texts.append(t[:at] + rng.choice(["", "X", "a word"]) + t[at + rng.randint(0, 3) :])
    line = " ".join(word() for _ in range(6))
    texts += [texts[0], texts[0], line * 9, "ab" * 200, "z" * 300, "ab" * 31, None, "", "short", line * 3 + "!" + line * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[1:]) for r in suffixdedup.remove_repeats(docs, length, digests=True).collect()}
    want = brute(texts, length)
    assert [rows[i] for i in range(len(texts))] == want


def test_edges(edge_docs, no_docs):
    rows = suffixdedup.remove_repeats(edge_docs, 400, digests=True).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == by[1]["n_bytes"] == by[2]["n_removed"] and by[1]["n_spans"] == 1
    assert by[7]["n_removed"] == by[7]["n_bytes"] == 90_000
    assert by[3]["n_bytes"] == by[4]["n_bytes"] == 0 and by[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffixdedup.remove_repeats(no_docs, 400).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.remove_repeats(edge_docs, 400).collect()}
    assert kept[1] == b"" and kept[8] == b"x"
