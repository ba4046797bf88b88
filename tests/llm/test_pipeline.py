import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer as Library

import corpus_pipeline
from lodestone.llm import bpe, decontaminate, langid, secrets
from lodestone.llm.common import written
from lodestone.llm.registry import oracle_sql, queries
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_against_brute_force(spark, sf):
    """Each stage's kept rows by hand, and the digests by the tokenizers library."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.fit(docs)
    rejected = {r["doc_id"] for r in langid.identify(docs, model).where("rejected").collect()}
    rows = {d: t for d, t in rows.items() if d not in rejected}
    group = brute_components({d: brute_print(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if group[d] == d}
    items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(f" {i} " in f" {' '.join(decontaminate.words_of(t))} " for i in items)}
    rows = {d: secrets.redact(t, secrets.scan(t)) for d, t in rows.items()}
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in rows.items():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want[d] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r[1:]) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_edges(spark, sf, edge_docs, no_docs):
    for source in (edge_docs, no_docs):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, docs, sf), "test")
            assert after.columns == source.columns and after.count() <= docs.count()
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "decontamination", "secret scan", "BPE encoding"]
    assert set(oracle_sql()) <= set(queries()) and bpe.BATCH_CHARS > 0


def test_queries_equal_their_sql(spark, sf):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, sf).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        same = [
            sorted(tuple("" if v is None or v is np.nan or str(v) in ("nan", "<NA>") else str(v) for v in row) for row in d[sorted(d.columns)].itertuples(index=False))
            for d in (got, want)
        ]
        assert same[0] == same[1], name
