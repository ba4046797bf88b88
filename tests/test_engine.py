import pytest
from pyspark.sql import functions as F

from lodestone import model
from lodestone.plans import ranking
from lodestone.plans.compiler import compile_detailed, compile_query
from lodestone.plans.engine import Engine, Table, types_present
from lodestone.plans.query import SearchQuery, Sort
from lodestone.settings import choose_backend
from lodestone.sources import views

NOW = 1_706_745_600_000


@pytest.fixture(scope="module")
def files(spark):
    names = ["alpha.txt", "bravo.txt", "alpha", "Visual Studio Code.exe", "code.exe", "xcode.exe", "notes.md", "readme"]
    rows = [(n, rf"C:\work\{n}", "txt" if n.endswith("txt") else None, "C", 100 * i, NOW - i * 86_400_000, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "name string, path string, extension string, drive string, size long, modified long, collect_ord long")
    return model.entities(df, "file")


@pytest.fixture(scope="module")
def apps(spark):
    df = spark.createDataFrame([("Code", r"C:\apps\code.exe", r"C:\apps\code.exe", "path", 0)], "name string, path string, target string, app_source string, collect_ord long")
    return model.entities(df, "application")


def names(df):
    return [r["name"] for r in df.collect()]


def test_order_of_matches(files, apps):
    engine = Engine([Table("apps", apps, ("application",)), Table("files", files, ("file",))], now=NOW)
    assert names(engine.search(SearchQuery.plain("code"))) == ["Code", "code.exe", "Visual Studio Code.exe", "xcode.exe"]
    assert names(engine.search(SearchQuery.plain("alpha")))[0] == "alpha"
    assert names(engine.search(SearchQuery.plain("vsc"))) == []  # files need the word itself
    assert names(engine.search(SearchQuery.plain("cd").with_types("application"))) == ["Code"]  # others match loosely


def test_response(files):
    engine = Engine([Table("files", files, ("file",))], now=NOW)
    got = engine.respond("type:file", compile_detailed("type:file").query, limit=3)
    assert (got.total, got.truncated, got.compiled) == (3, True, "type:file")
    row = engine.respond("code", SearchQuery.plain("code.exe")).results[0]
    assert row["matched_field"] == "name" and [(r["start"], r["end"]) for r in row["match_ranges"]] == [(0, 8)]
    assert row["metadata"]["size_bytes"] == "400" and row["subtitle"].endswith("code.exe")
    assert "TakeOrderedAndProject" in engine.explain(SearchQuery.plain("code"))


def test_providers_that_fail_or_are_not_asked(files):
    class Broken:
        name, scope, types = "broken", "live", ("window",)

        def collect(self, query):
            raise OSError("gone")

    engine = Engine([Table("files", files, ("file",)), Broken()], now=NOW)
    assert engine.respond("x", SearchQuery(types=("file",))).warnings == []
    assert engine.respond("x", SearchQuery.plain("alpha")).warnings == ["broken: gone"]
    assert engine.respond("x", SearchQuery().with_filter("name", "nothing-here")).warnings == []
    with pytest.raises(ValueError):
        engine.search(SearchQuery(types=("window",)))


def test_extension_alternatives_and_sort(files):
    engine = Engine([Table("files", files)], now=NOW)
    both = compile_detailed("ext:txt,md").query
    assert engine.candidates(both).count() == 0 and engine.candidates(both, ext_any=True).count() == 2
    query = SearchQuery(sort=Sort("size", "asc"))
    assert names(engine.search(query, limit=2)) == ["alpha.txt", "bravo.txt"]


def test_rankers_and_weights(files):
    weights = ranking.Weights()
    assert weights.scaled(2).exact == 200 and weights.scaled(2).path_factor == 0.5 and weights.without_fuzzy().fuzzy == 0
    flat = Engine([Table("files", files)], now=NOW, ranker=ranking.noop()).scored(SearchQuery())
    assert flat.agg(F.max("score")).first()[0] == 0
    assert Engine([Table("f", files)], now=NOW, ranker=ranking.heuristic(NOW, ranking.Weights(minimum=1000.0))).scored(SearchQuery()).count() == 0


def test_timings_and_types_in_order(spark, sf):
    tables = [Table("files", views.entities(spark, sf, "e_file"), ("file",)), Table("services", views.entities(spark, sf, "e_svc"), ("service",))]
    engine = Engine(tables, now=views.NOW_MS)
    took = engine.timings(compile_detailed("svc1").query)
    assert [t[0] for t in took] == ["files", "services"] and took[1][1] > 0 and all(t[2] > 0 for t in took)
    assert [t[0] for t in engine.timings(compile_detailed("type:service svc1").query)] == ["services"]
    results = spark.createDataFrame([(1, "file"), (2, "window"), (3, "file"), (4, "service")], "rank int, entity_type string")
    assert [tuple(r) for r in types_present(results).orderBy("position").collect()] == [(1, "file"), (2, "window"), (3, "service")]


def test_another_compiler():
    class Shouting:
        def compile_detailed(self, line):
            return compile_detailed(line.lower())

    assert compile_query("TYPE:FILE Report", compiler=Shouting()).to_dsl() == compile_query("type:file report").to_dsl()


def test_backends():
    assert choose_backend("scan", True) == ("scan", []) and choose_backend("auto", True) == ("journal", [])
    backend, warnings = choose_backend("auto", False)
    assert backend == "scan" and warnings and choose_backend("journal", True) == ("journal", [])
    with pytest.raises(ValueError):
        choose_backend("journal", False)
