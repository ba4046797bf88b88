import random

import numpy as np
import pytest

from lodestone.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of many sentences; a toxic one has one sentence with bad words, whose place nobody tells."""
    rng = random.Random(1)
    vocab = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(700):
        sentences = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " Vile" + rng.choice(["ness", "ly", "!", ""])
        rows.append((i, ". ".join(sentences) + ".", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic"), {r[0]: r for r in rows}


@pytest.fixture(scope="module")
def model(labelled):
    docs, labels, _ = labelled
    return toxicity.fit(docs, labels.where("doc_id < 500"))


def test_held_out_documents_and_sentences(labelled, model):
    docs, _, rows = labelled
    found = toxicity.score_toxicity(docs.where("doc_id >= 500"), model).collect()
    right = [(r["score"] >= 0.5) == bool(rows[r["doc_id"]][2]) for r in found]
    assert np.mean(right) > 0.95
    for r in found:
        for s in r["sentences"]:
            if s["p"] > 0.9:
                assert "Vile" in rows[r["doc_id"]][1][s["start"] : s["end"]]


def test_few_labels(spark):
    """A small fit learns the words that several of its documents share."""
    rng = random.Random(4)
    vocab = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(160):
        parts = [" ".join(rng.choice(vocab) for _ in range(6)) for _ in range(4)]
        if i % 8 == 0:
            parts[rng.randrange(4)] += " vile" + rng.choice(["ness", "ly"])
        rows.append((i, ". ".join(parts), int(i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 120").select("doc_id", "toxic"))
    found = toxicity.score_toxicity(df.where("doc_id >= 120").select("doc_id", "text"), model).collect()
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 8 == 0) for r in found) >= 38


def test_long_texts_take_part_by_sentences_from_all_over():
    text = ". ".join(f"sentence number {i} of many" for i in range(9000)) + "."
    short = toxicity.shortened(text)
    numbers = [int(s.split()[2]) for s in short.split("\n")]
    assert 0.9 * toxicity.FIT_CHARS < len(short) <= 1.2 * toxicity.FIT_CHARS
    assert numbers == sorted(numbers) and min(numbers) < 100 and max(numbers) > 8900
    assert toxicity.shortened("short. text") == "short. text" and len(toxicity.shortened("x" * 90_000)) == toxicity.FIT_CHARS


def test_scores_are_not_negative_zero(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1000.0)
    rows = toxicity.score_toxicity(spark.createDataFrame([(1, ""), (2, "x")], "doc_id long, text string"), model).collect()
    assert all(str(r["score"]) == "0.0" for r in rows)


def test_noisy_or():
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    weights[toxicity.features("bad")] = 1.0
    score = toxicity.Model(weights, -4.0).scorer()
    assert score("so bad bad") == pytest.approx(0.5)  # each word counts once
    assert score("fine") == pytest.approx(1 / (1 + np.exp(4)))


def test_sentences():
    text = "One. two!\nThree?? "
    assert [text[s:e] for s, e in toxicity.sentences(text)] == ["One", " two", "Three"]
    assert list(toxicity.sentences(None)) == list(toxicity.sentences(" . ")) == []


def test_edges(spark, edge_docs, no_docs, model):
    rows = toxicity.score_toxicity(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    nothing = toxicity.fit(edge_docs, labels)
    assert {r["score"] for r in toxicity.score_toxicity(edge_docs, nothing).collect()} == {0.0}
