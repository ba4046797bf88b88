import random

import numpy as np

from lodestone.llm import decontaminate as dc


def items_of(spark, sf):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def test_wand_equals_scoring_all(spark, sf):
    index = dc.Index(items_of(spark, sf))
    rng = random.Random(1)
    names = sorted(index.terms)
    for _ in range(300):
        terms = sorted({index.terms[rng.choice(names)] for _ in range(rng.randint(0, 120))})
        score = {}
        for t in terms:
            for i, x in zip(index.postings[t], index.impacts[t]):
                score[i] = score.get(i, 0) + x
        for least in (0.02, 0.1, 0.3):
            got = dict(index.search(np.array(terms, np.int64), least))
            assert {i for i, x in score.items() if x >= least + 1e-9} <= set(got) <= {i for i, x in score.items() if x >= least - 2e-9}
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_finds_every_leak_and_nothing_else(spark, sf):
    """Against a plain search of the items' words in order, on the driver's documents."""
    items = items_of(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {
        (d["doc_id"], i) for d in docs.collect() for i, t in items if f" {' '.join(dc.words_of(t))} " in f" {' '.join(dc.words_of(d['text']))} "
    }
    rows = dc.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in rows} == want
    kept = {r["doc_id"] for r in dc.drop_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert kept == {d["doc_id"] for d in docs.collect()} - {d for d, _ in want}


def test_blocks_of_items_and_partial_leaks(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_ITEMS", 2)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(12)) + ".") for i in range(5)]
    filler = lambda n: " ".join(word() for _ in range(n))
    whole, question, small = items[0][1], items[1][1].split(". ")[0], items[2][1].split()
    small[5] = "changed"
    docs = spark.createDataFrame(
        [(1, filler(300) + " " + whole.upper() + " " + filler(100)), (2, filler(50) + question), (3, " ".join(small)), (4, filler(400))],
        "doc_id long, text string",
    )
    table = spark.createDataFrame([*items, (9, None), (10, ""), (11, "one"), (12, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, table).collect()}
    # The second document lacks the answer; the third lacks 5 of 26 shingles of the question, which leaves 0.8.
    assert got == {(1, 0), (1, 12), (3, 2)}


def test_finds_every_verbatim_item(spark, sf):
    """Against plain substring search of the raw item text."""
    sf = sf.replace("0.001", "0.1")
    docs, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    texts = items_of(spark, sf)
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in texts if t in (d["text"] or "")}
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()}


def test_scores_do_not_depend_on_the_layout(spark, sf, monkeypatch):
    """Partial leaks, scored with all items in one block and in many, and in another order: the same rows, to the bit."""
    items = spark.createDataFrame([*items_of(spark, sf), (900, "word " * 150 + "end.")], "item_id long, text string")
    rng = random.Random(4)
    texts = []
    for i, t in items_of(spark, sf):
        words = t.split()
        at = rng.randrange(len(words))
        texts += [" ".join(words[: int(len(words) * 0.85)]), " ".join(words[:at] + ["changed"] + words[at + 1 :]), "before " * 70 + t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, dc.find_leaks(docs, items).collect()))
    assert len(want) > 40
    monkeypatch.setattr(dc, "MOST_ITEMS", 3)
    monkeypatch.setattr(dc, "HELD", 5000)
    assert sorted(map(tuple, dc.find_leaks(docs, items.orderBy("text").repartition(3)).collect())) == want
    kept = {r["doc_id"] for r in dc.drop_leaks(docs, items).collect()}
    assert kept == set(range(len(texts))) - {r[0] for r in want}


def test_other_kinds_of_ids(spark):
    text = "some words that make an item of more than five. And the answer to it is here."
    items = spark.createDataFrame([("a", text), (None, text)], "item_id string, text string").selectExpr("CAST(NULL AS DATE) AS item_id", "text")
    docs = spark.createDataFrame([("x", f"he said {text}")], "doc_id string, text string")
    assert [tuple(r[:2]) for r in dc.find_leaks(docs, items).collect()] == [("x", None)] * 2


def test_glued_ends_and_edge_words_of_short_answers(spark):
    question = "ten words make up the question that is asked here."
    items = spark.createDataFrame([(1, f"{question} Five words are the answer."), (2, f"{question} Berlin.")], "item_id long, text string")
    texts = [
        f"&&&{question} Five words are the answer.%%% more",
        f"glued{question} Five words are the answers",
        f"{question} Five words are the reply",
        f"{question} Four words are the reply",
        f"{question} berlin%%%",
        f"{question} dublin",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()}
    assert found == {(0, 1), (1, 1), (2, 1), (4, 2)}


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "some words to read here and there")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(edge_docs, items).count() == 0
    assert dc.find_leaks(edge_docs, none).count() == dc.find_leaks(no_docs, items).count() == 0
    assert dc.drop_leaks(edge_docs, none).count() == dc.drop_leaks(edge_docs, items).count() == edge_docs.count()
    assert dc.drop_leaks(edge_docs, items).columns == edge_docs.columns
