import struct

import pytest

from lodestone.plans.engine import Table
from lodestone.plans.query import QueryError, SearchQuery
from lodestone.service import SearchService
from lodestone.settings import Settings
from lodestone.sources import snapshots, usn, views


@pytest.fixture
def service(spark, sf, tmp_path):
    return SearchService(spark, [Table("all", views.entities(spark, sf, "e_file", "e_svc"), ("file", "service"))], usage_log=str(tmp_path / "usage.json"), now=views.NOW_MS)


def test_search_and_limits(service):
    assert service.search("type:file limit:3").total == 3 and service.search("type:file limit:3", limit=5).total == 5
    assert service.search("type:file").total == 50 and service.search("doc-", types=("service",)).total == 0
    assert "Scan parquet" in service.explain("type:file")
    assert service.search_query(SearchQuery(types=("service",), limit=4)).truncated


def test_selections_raise_what_was_chosen(service):
    query = "type:file doc-1"
    before = [r["id"] for r in service.search(query).results]
    chosen = before[-1]
    for _ in range(3):
        service.record_selection(query, chosen)
    after = [r["id"] for r in service.search(query).results]
    assert after.index(chosen) < before.index(chosen)
    assert service.recent_selections()[0]["selection_count"] == 3
    service.usage_log.write_text("{broken\n")
    assert service.used() is None
    service.reset_usage()
    assert service.recent_selections() == []


def test_tools(service):
    got = service.call("search_files", {"query": "type:file doc-1", "limit": 2, "filters": {"extension": "en"}})
    assert got["compiled"] == "type:file type:directory ext:en doc-1 limit:2" and len(got["results"]) == 2
    assert service.call("compile_query", {"query": "recent PDFs"})["source"] == "natural-language"
    assert {p["entity_type"] for p in service.call("index_status", {})["providers"]} == {"file", "service"}
    assert "mtime" in service.call("dsl_reference", {})["keys"]["modified"]
    assert service.call("record_selection", {"query": "q", "entity_id": "x"}) == {"recorded": True}
    for tool, arguments in (("nothing", {}), ("search_system", {}), ("search_files", {"query": "x", "filters": {"size": 1}})):
        with pytest.raises(QueryError):
            service.call(tool, arguments)


def test_settings(tmp_path):
    path = tmp_path / "s" / "settings.json"
    assert Settings.load(path) == Settings()
    Settings(result_limit=99999, indexed_drives=("d", "c", "c", "1"), max_index_entries=1, index_backend="x").save(path)
    got = Settings.load(path)
    assert (got.result_limit, got.indexed_drives, got.max_index_entries, got.index_backend) == (2000, ("C", "D"), 1000, "auto")
    path.write_text('{"resultLimit": "many"}')
    assert Settings.load(path) == Settings()


def test_snapshots_are_kept_for_a_while(spark):
    taken = []

    def take(query):
        taken.append(query)
        return spark.range(1)

    one = snapshots.Snapshot("s", ("service",), take, kept=60)
    one.collect(SearchQuery())
    one.collect(SearchQuery())
    assert len(taken) == 1
    one.refresh()
    one.collect(SearchQuery())
    assert len(taken) == 2
    rows = snapshots.processes(spark).collect(SearchQuery())
    import os

    assert rows.where(f"pid = {os.getpid()}").count() == 1


def test_windows_and_applications(spark, sf):
    windows = views.entities(spark, sf, "e_win")
    got = snapshots.windows(windows, views.entities(spark, sf, "e_proc"))
    assert got.count() == windows.where("trim(name) <> ''").count() and got.where("process_name is not null").count() > 0
    apps = views.entities(spark, sf, "e_app")
    assert snapshots.applications([apps, apps]).count() == apps.selectExpr("lower(target)").distinct().count()


def record(name, length=None, reason=0x100, ticks=116_444_736_000_000_000 + 10_000):
    raw = name.encode("utf-16-le")
    size = 60 + len(raw)
    head = struct.pack("<IHHQQqqIIIIHH", length or size, 2, 0, 7, 1 << 63, 99, ticks, reason, 0, 0, 0x10, len(raw), 60)
    return head + raw


def test_journal_buffers(spark):
    whole = b"\0" * 8 + record("a.txt") + record("年度", ticks=0)
    rows = list(usn.parse(whole))
    assert [r[-1] for r in rows] == ["a.txt", "年度"] and rows[0][:6] == (7, -(1 << 63), 99, 1, 0x100, True) and rows[1][3] == 0
    for broken in (b"", whole[:-3], b"\0" * 8 + record("x", length=4), b"\0" * 8 + record("a")[:40]):
        assert len(list(usn.parse(broken))) <= 1
    df = spark.createDataFrame([("v", bytearray(whole)), ("w", None)], "volume_id string, bytes binary")
    assert usn.decode(df).count() == 2
