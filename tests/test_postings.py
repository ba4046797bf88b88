import random

import pytest
from pyspark.sql import functions as F

from lodestone import model
from lodestone.operators import catalogue, postings, tree, usage
from lodestone.operators.postings import Indexed
from lodestone.plans.compiler import compile_detailed
from lodestone.plans.engine import Engine, Table

#: A line of each kind: words that are frequent, rare, short, absent, not ASCII; each filter that the indexes know, alone,
#: together, with a word, and twice; and lines that no index helps.
QUERIES = [
    "maple", "maple-7", "MAPLE", "q", "qu", "qua", "tz-1", "zzz", "wombat", "под", "отчёт", "отчёт-за-год", "two words", "under_score",
    "type:file ext:zip", "ext:.ZIP raven", "ext:none", "ext:zip ext:zip", "prefix:rav", "prefix:RAVEN-1", "prefix:x", "prefix:отч",
    "path:kiln", "path:kiln raven", "path:nowhere", "ext:css path:kiln", "ext:css path:kiln raven", "prefix:raven path:kiln ext:css",
    "name:maple", "name:maple path:raven", "ext:css a", "type:file", "size:>3",
]
EDGES = ["отчёт-за-год.zip", "QUARTZ.CSS", "q.bat", "qu.bat", "qua.bat", "Two Words Here.zip", "raven", ".zip", "under_score and-dash.css"]
STEMS, ENDINGS = ("maple", "quartz", "raven", "kiln", "sable", "jade", "heron"), ("zip", "css", "bat", "html")


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(20)
    rows = [(i, f"{rng.choice(STEMS)}-{rng.randrange(90)}.{rng.choice(ENDINGS)}", rng.choice(STEMS)) for i in range(800)]
    rows += [(2000 + i, n, "odd") for i, n in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "record_id long, name string, folder string")
    return df.selectExpr(
        "record_id", "name", "lower(name) AS lname", "concat('c:\\\\', folder, '\\\\', name) AS path", "lower(concat('c:\\\\', folder, '\\\\', name)) AS lpath",
        "regexp_extract(name, '\\\\.([^.]+)$', 1) AS extension"
    ).cache()


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings"))
    postings.Postings.build(files).save(path)
    return postings.Postings.load(spark, path)


def engine_of(rows, index, key="file_id"):
    """The engine over files as entities, with indexes or without."""
    raw = rows.select("name", "path", "extension", F.length("name").alias("size"), F.col("record_id").alias("file_id"), F.col("record_id").alias("collect_ord"))
    found = model.entities(raw, "file")
    return Engine([Indexed("files", found, index) if index else Table("files", found)], now=0)


def kept(engine, line):
    return sorted(r["file_id"] for r in engine.candidates(compile_detailed(line).query).select("file_id").collect())


@pytest.mark.parametrize("line", QUERIES)
def test_same_with_and_without(files, index, line):
    assert kept(engine_of(files, index), line) == kept(engine_of(files, None), line)


def test_plans(files, index):
    kind = lambda line: index.candidates(compile_detailed(line).query)[1].kind
    assert kind("type:file") == "linear" and kind("qu") == "linear"
    assert kind("ext:zip") == "extension" and kind("prefix:rav") == "prefix" and kind("wombat") == "trigram"
    assert kind("ext:css path:kiln") == "intersection" and kind("maple path:kiln") == "trigram"


def test_explain_tells_the_sources(files, index):
    told = engine_of(files, index).explain(compile_detailed("ext:css path:kiln").query)
    first = told.splitlines()[0]
    assert first.startswith("files: intersection; ") and "extension 'css'" in first and "trigram 'kiln'" in first
    assert "Physical Plan" in told
    waiting = engine_of(files, index)
    waiting.providers[0].postings = None
    assert waiting.explain(compile_detailed("ext:css").query).startswith("files: linear (indexes are not ready)")


def test_frequent_grams_are_dropped(spark, monkeypatch, files):
    monkeypatch.setattr(postings, "FLOOR", 20)
    few = postings.Postings.build(files)
    stats = few.statistics().first()
    assert stats["dropped_grams"] > 0 and stats["postings"] == few.trigram.count() and stats["extensions"] == 4
    assert kept(engine_of(files, few), "maple-1") == kept(engine_of(files, None), "maple-1")


def test_repeated_record_ids(spark, files):
    """Two rows of one id are candidates if either can match."""
    twice = files.unionByName(files.where("record_id % 2 = 0").withColumn("path", F.lit("c:\\x\\wombat-1.zip")).withColumn("lpath", F.col("path")).withColumn("name", F.lit("wombat-1.zip")).withColumn("lname", F.col("name")))
    for line in ("wombat-1", "maple-1", "path:raven"):
        assert kept(engine_of(twice, postings.Postings.build(twice)), line) == kept(engine_of(twice, None), line)


def test_changes_are_found_without_new_indexes(spark, files, index):
    """New records, and others with new names; grams that no record had before are known, and those gone do no harm."""
    moved = files.where("record_id < 5 OR record_id = 2001").withColumn("path", F.concat(F.lit("d:\\wombat\\"), F.col("name"), F.lit(".xyz")))
    new = moved.withColumn("record_id", F.col("record_id") + 5000).unionByName(moved.where("record_id < 5"))
    new = new.withColumn("lpath", F.lower("path")).withColumn("name", F.concat("name", F.lit(".xyz"))).withColumn("lname", F.lower("name")).withColumn("extension", F.lit("xyz"))
    now = files.join(new, "record_id", "left_anti").unionByName(new)
    after = index.updated(new)
    for line in ("ext:xyz", "path:wombat", "prefix:maple", "maple-7", "xyz", "ext:zip"):
        assert kept(engine_of(now, after), line) == kept(engine_of(now, None), line)
    assert len(kept(engine_of(now, after), "path:wombat")) == 11
    gone = new.where("record_id >= 5000")
    left = now.join(gone, "record_id", "left_anti")
    assert kept(engine_of(left, after.without(gone)), "ext:xyz") == kept(engine_of(left, None), "ext:xyz") == [0, 1, 2, 3, 4]


def test_when_to_build_anew():
    assert [postings.needs_compaction(n, c) for n, c in ((0, 5), (100, 999), (100, 1000), (40_000, 1999), (40_000, 2000), (10**7, 19_999), (10**7, 20_000))] == [
        False, False, True, False, True, False, True
    ]


def test_any_of_several_extensions(index, files):
    got = sorted(r["record_id"] for r in index.lookup_any([".ZIP", "bat", "none"]).collect())
    assert got == sorted(r["record_id"] for r in files.where("lower(extension) IN ('zip', 'bat')").collect())


def test_paths_drop_orphans_and_cycles(spark):
    rows = [(1, None, "C:\\", False), (2, 1, "a", False), (3, 2, "b.txt", False), (5, 99, "orphan", False), (6, 7, "x", False), (7, 6, "y", False), (8, 8, "D:", False), (9, 0, "E:", True)]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, is_deleted boolean")
    got = {r["id"]: r["path"] for r in tree.paths(df).collect()}
    assert got == {1: "C:\\", 2: "C:\\a", 3: "C:\\a\\b.txt", 8: "D:", 9: "E:"}
    assert [r["id"] for r in tree.consistency(df).collect()] == [5]


def test_deep_paths(spark):
    rows = [(i, i - 1 if i > 1 else None, f"d{i}") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id long, parent_id long, name string")
    assert tree.paths(df).agg(F.max("depth")).first()[0] == 39
    with pytest.raises(RecursionError):
        tree.paths(df, most_depth=10)


def test_catalogue(spark):
    rows = [("a", "C:\\X.exe", "path", 0), ("b", "c:\\x.EXE", "start-menu", 1), ("c", "C:\\x.exe", "start-menu", 2), ("d", " ", "app-paths", 3), ("e", "y", "windows-apps", 4)]
    apps = spark.createDataFrame(rows, "name string, target string, app_source string, collect_ord long")
    best = catalogue.deduplicated(apps)
    assert [r["name"] for r in catalogue.in_order(best).collect()] == ["b", "e"]
    assert {r["app_source"]: r["n"] for r in catalogue.per_source(best).collect()} == {"start-menu": 1, "windows-apps": 1}


def test_usage_capacity(spark):
    log = spark.createDataFrame([(f"f{i % 30}", f"q{i}", i) for i in range(90)] + [("", "q", 1)], "entity_id string, query string, ts_ms long")
    used = usage.usage_of(log, capacity=20)
    assert used.count() == 20 and used.agg(F.min("last_selected_ms")).first()[0] == 70
    assert [r["entity_id"] for r in usage.recent(used, 2).collect()] == ["f29", "f28"] and used.first()["query"] == "q89"
