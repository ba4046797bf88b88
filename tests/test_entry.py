import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodestone import queries

ROOT = Path(__file__).resolve().parent.parent


def flat(df):
    def text(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = {c for d in (got, want) for c in d.columns if d[c].dtype.kind == "f"}
    for c in floats:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert flat(got) == flat(want)


def test_entry_without_the_training_operators(tmp_path):
    """The rest imports and answers when those operators and the pipeline are gone."""
    for name in ("lodestone", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
