import io
import struct

import pytest
from pyspark.sql import functions as F

from lodestone import model, rpc
from lodestone.plans.compiler import compile_detailed
from lodestone.plans.engine import Engine
from lodestone.plans.query import SearchQuery
from lodestone.service import SearchService
from lodestone.sources import recorded, snapshots, walk
from lodestone.streaming import journal


@pytest.fixture(scope="module")
def services(spark):
    listed = spark.createDataFrame(
        [("spooler", "Print Queue", "running", 10, 0), ("backup", None, "stopped", None, 1), ("Tunnel", "Private Network", "running", 12, 2)],
        "name string, svc_display_name string, svc_state string, pid long, collect_ord long",
    )
    config = spark.createDataFrame(
        [("spooler", "auto", "system", r"C:\sys\spool.exe"), ("backup", "manual", "me", r"D:\bak.exe")],
        "name string, svc_start_type string, account string, path string",
    )
    return recorded.services(listed, config)


@pytest.mark.parametrize(
    ("line", "known"),
    [("type:service", {"spooler", "backup"}), ("type:service print", {"spooler"}), ("type:service BACK", {"backup"}), ("type:service state:manual zzz", {"spooler", "backup"}),
     ("type:service path:bak zzz", {"spooler", "backup"}), ("type:service private", set())],
)
def test_configuration_that_a_query_can_want(services, line, known):
    rows = services.collect(compile_detailed(line).query).collect()
    assert len(rows) == 3 and {r["name"] for r in rows if r["account"]} == known


def test_service_filters_need_the_configuration(services):
    engine = Engine([services], now=0)
    got = lambda line: {r["name"] for r in engine.candidates(compile_detailed(line).query).collect()}
    assert got("type:service state:manual") == {"backup"} and got("type:service path:spool") == {"spooler"}


def test_windows_with_titles_and_their_processes(spark):
    listed = spark.createDataFrame([("Notes", 1, 5, "c", True, 0), (" ", 2, 5, "c", True, 1), ("Lost", 3, 99, "c", False, 2)], "name string, hwnd long, pid long, class_name string, visible boolean, collect_ord long")
    processes = spark.createDataFrame([(5, "notes.exe")], "pid long, name string")
    rows = {r["name"]: r["process_name"] for r in recorded.windows(listed, processes).collect(SearchQuery()).collect()}
    assert rows == {"Notes": "notes.exe", "Lost": None}


def test_catalogue_of_four_sources(spark, tmp_path):
    for path in ("menu/Paint.lnk", "menu/a/b/c/d/e/Deep-Tool.LNK", "menu/a/b/c/d/e/f/too-deep.lnk", "menu/readme.txt", "apps/code.exe", "bin/code.exe", "bin/x/not-direct.exe", "bin/.exe"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("")
    spark.dataSource.register(walk.WalkSource)
    found = spark.read.format("walk").option("roots", str(tmp_path)).load()
    registered = spark.createDataFrame([("code.exe", f"{tmp_path}/bin/CODE.exe", "w", 0), ("blank.exe", " ", None, 1), ("null.exe", None, None, 2)], "key string, target string, working_dir string, collect_ord long")
    sources = [
        recorded.app_paths(registered), recorded.start_menu(found, f"{tmp_path}/menu"),
        recorded.executables(found, [f"{tmp_path}/apps"], "windows-apps"), recorded.executables(found, [f"{tmp_path}/bin/"], "path"),
    ]
    got = {(r["name"], r["app_source"]) for r in recorded.applications(sources).collect(SearchQuery()).collect()}
    assert got == {("Code", "app-paths"), ("Paint", "start-menu"), ("Deep Tool", "start-menu"), ("Code", "windows-apps")}


def test_enumeration(spark):
    rows = [(5, 5, ".", 0x10, 1), (6, 5, "docs", 0x10, 2), (7, 6, "a.TXT", 0x20, 3), (8, 99, "lost", 0x20, 4), (9, 6, "none", 0, 5)]
    found = recorded.enumerated(spark.createDataFrame(rows, "frn long, parent_frn long, name string, attributes long, modified long"), "d")
    got = {(r["entity_type"], r["path"], r["extension"], r["modified"], r["size"], r["drive"]) for r in found.collect()}
    assert got == {("directory", "D:\\docs", None, 2, None, "D"), ("file", "D:\\docs\\a.TXT", "TXT", 3, None, "D"), ("file", "D:\\docs\\none", None, 5, None, "D")}


def test_volumes(spark, tmp_path):
    mounts = tmp_path / "mounts"
    mounts.write_text("/dev/SDA1 / ext4 rw 0 0\nproc /proc proc rw 0 0\n/dev/sda1 /home ext4 rw 0 0\nnas:/x /no/such nfs rw 0 0\n")
    rows = [r.asDict() for r in recorded.volumes(spark, str(mounts)).collect()]
    assert [(r["volume_id"], r["mount_points"], r["file_system"]) for r in rows] == [("/dev/sda1", ["/", "/home"], "ext4"), ("nas:/x", ["/no/such"], "nfs")]
    assert rows[0]["total"] >= rows[0]["free"] > 0 and rows[1]["total"] is None


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    names = ["alpha.txt", "beta.txt", "gamma.md"]
    rows = [(n, rf"C:\work\{n}", n.split(".")[1], "C", 10, 1, i + 1, i) for i, n in enumerate(names)]
    table = lambda: model.entities(spark.createDataFrame(rows, "name string, path string, extension string, drive string, size long, modified long, file_id long, collect_ord long"), "file")
    live = snapshots.Snapshot("live", ("process",), lambda query: model.entities(spark.createDataFrame([("x.exe", 1)], "name string, pid long"), "process"), kept=3600.0)
    return SearchService(spark, [live], now=7, index_root=str(tmp_path_factory.mktemp("index")), scan=table)


def test_rebuild_and_refresh(service, spark):
    assert service.rebuild() == 3 and [p.name for p in service.providers] == ["live", "files"]
    got = service.search("type:file ext:txt")
    assert [r["name"] for r in got.results] == ["alpha.txt", "beta.txt"]
    assert service.explain("ext:md gamma").startswith("files: ")
    before = service.providers[0].collect(SearchQuery())
    assert service.providers[0].collect(SearchQuery()) is before
    assert service.refresh() == ["live"] and service.providers[0].collect(SearchQuery()) is not before
    with pytest.raises(ValueError):
        SearchService(spark, []).rebuild()


def test_requests(service, spark):
    ask = lambda **request: rpc.handle(service, request)
    assert ask(kind="hello", protocol_version=rpc.VERSION)["protocol_version"] == rpc.VERSION
    assert ask(kind="hello", protocol_version=99)["code"] == "protocol-mismatch"
    assert ask(kind="rebuild-volume")["entries"] == 3
    got = ask(kind="search", query="alpha", types=["file", "bogus"], limit=5)
    assert got["total"] == 1 and got["results"][0]["name"] == "alpha.txt"
    assert ask(kind="search", query=3)["code"] == "invalid-query" and ask(kind="what")["code"] == "unknown-request"
    assert {p["provider"] for p in ask(kind="index-status")["providers"]} == {"live", "files"}
    assert ask(kind="changes")["code"] == "no-journal"
    readings = spark.createDataFrame([("v", 1, 7, 0, 10, 10), ("v", 2, 7, 0, 30, 30)], "volume_id string, seq long, journal_id long, first_usn long, next_usn long, applied_usn long")
    moved = rpc.handle(service, {"kind": "changes", "since_usn": 5}, journal.decisions(readings))["changes"]
    assert [(c["from_usn"], c["to_usn"]) for c in moved] == [(10, 30)]


def test_frames(service):
    asked = io.BytesIO(rpc.frame({"kind": "hello", "protocol_version": 1}) + rpc.frame({"kind": "search", "query": "beta"}))
    told = io.BytesIO()
    assert rpc.serve(service, asked, told) == 2
    told.seek(0)
    assert [rpc.read_frame(told)["kind"] for _ in range(2)] == ["hello", "search"] and rpc.read_frame(told) is None
    whole = rpc.frame({"a": "é"})
    head = struct.calcsize(rpc.HEADER)
    broken = [whole[:-1], whole[:3], b"XX" + whole[2:], struct.pack(rpc.HEADER, rpc.MOST_BYTES + 1, rpc.MARK, rpc.VERSION),
              struct.pack(rpc.HEADER, 1, rpc.MARK, rpc.VERSION) + b"{", struct.pack(rpc.HEADER, 1, rpc.MARK, rpc.VERSION) + b"3"]
    for raw in broken:
        with pytest.raises(rpc.FrameError):
            rpc.read_frame(io.BytesIO(raw))
    assert rpc.read_frame(io.BytesIO(whole)) == {"a": "é"} and len(whole) > head
    with pytest.raises(rpc.FrameError):
        rpc.frame({"a": "x" * rpc.MOST_BYTES})
    told = io.BytesIO()
    assert rpc.serve(service, io.BytesIO(b"junk"), told) == 0 and b"bad-frame" in told.getvalue()
