import numpy as np
import pytest

from lodestone.llm import langid
from lodestone.llm.common import id_fold


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs.where(id_fold("doc_id", 4) != 2), docs=600)


def test_held_out_accuracy(docs, model):
    held = docs.where(id_fold("doc_id", 4) == 2)
    rows = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["rejected"] for r in rows) <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_unlearned_texts_go_and_mixtures_stay(spark, docs, model):
    rng = np.random.default_rng(3)
    scripts = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join("".join(rng.choice(list(s), 6)) for _ in range(n)) for s in scripts for n in (20, 100, 1000) for _ in range(5)]
    held = docs.where(id_fold("doc_id", 4) == 2).where("length(text) > 600").orderBy("doc_id").collect()
    texts += langid.dealt_anew([r["text"] for r in held[:40]])
    mixed = [a["text"][:300] + " " + b["text"][:300] for a, b in zip(held, held[1:]) if a["lang"] != b["lang"]]
    assert len(mixed) > 20
    rows = [(i, t) for i, t in enumerate(texts + mixed)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    rejected = {r["doc_id"] for r in found if r["rejected"]}
    assert rejected >= set(range(len(texts)))
    assert len(rejected) - len(texts) <= 0.02 * len(mixed)


def test_a_language_that_was_left_out_goes(docs):
    """It has the script of those that are learnt, and is rejected by its subwords alone."""
    model = langid.fit(docs.where("lang <> 'de'"), docs=600)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where("length(text) > 200").collect()
    share = lambda own: np.mean([r["rejected"] for r in rows if (r["lang"] == "de") != own and r["lang"]])
    assert share(False) >= 0.9 and share(True) <= 0.02


def test_symbols_that_are_no_letters(spark, model):
    """Fractions, powers, Roman and circled numbers are no letters; letters of any script are."""
    texts = ["½ ²³ ①② Ⅷ 42 _ !", "½x", "ª", "ʰ", "漢", "١٢٣"]
    found = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    rows = {r["doc_id"]: r["lang_pred"] == "und" for r in found.collect()}
    assert rows == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_a_rare_language_and_copies(spark):
    """A language of few documents is learnt beside copies that are most of the rows."""
    rng = np.random.default_rng(9)
    made = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [("xx", made("abcdefgh")) for _ in range(400)] + [("yy", made("mnopqrst")) for _ in range(12)]
    rows += [("xx", rows[0][1])] * 3000
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = langid.fit(df, docs=100)
    assert model.languages == ["xx", "yy"]
    test = spark.createDataFrame([(0, made("abcdefgh")), (1, made("mnopqrst"))], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(test, model).orderBy("doc_id").collect()] == ["xx", "yy"]


def test_whole_texts_are_counted():
    text = "one two three " * 30_000
    ids, counts = langid.bag(text)
    once, of = langid.subwords(["one", "two", "three"])
    assert counts.sum() == 30_000 * len(once) and set(ids) == set(once)


def test_subwords_by_hand():
    ids, of = langid.subwords(["ab", "c"])
    # <ab>: itself, 3 pairs, 2 triples, 1 of four; <c>: itself, 2 pairs, 1 triple.
    assert np.bincount(of).tolist() == [7, 4]
    again, _ = langid.subwords(["c"])
    assert sorted(ids[of == 1]) == sorted(again)
    assert len(langid.subwords([])[0]) == 0


def test_edges(edge_docs, no_docs, model):
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    kept = langid.keep_identified(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert langid.identify(no_docs, model).count() == langid.keep_identified(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(edge_docs, nothing).collect()} == {"und"}
    assert langid.keep_identified(edge_docs, nothing).count() == 0


def test_same_model_from_same_rows(docs):
    a, b = (langid.fit(docs.repartition(n), docs=100) for n in (1, 3))
    assert a.languages == b.languages and np.allclose(a.table, b.table) and a.reject == pytest.approx(b.reject)
