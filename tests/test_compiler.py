import pytest

from lodestone.functions import clock
from lodestone.plans.compiler import compile_detailed, compile_query
from lodestone.plans.dsl import parse, split_tokens
from lodestone.plans.query import Filter, QueryError, SearchQuery, SizeBound, Sort, TimeBound, filters_from_json

PAIRS = {
    "type:file ext:zip modified:<3d sort:size-asc limit:25": "type:file ext:zip modified:<3d sort:size-asc limit:25",
    "最近的 docx": "type:file ext:docx sort:modified-desc",
    "latest docx": "type:file ext:docx sort:modified-desc",
    "newest mp4 files": "type:file ext:mp4 sort:modified-desc",
    "running perl processes": "type:process perl",
    "正在运行的 perl": "type:process perl",
    "show me Blender": "blender",
    "显示 Blender": "blender",
    "yesterday changed kotlin files": "type:file ext:kt modified:<24h",
    "昨天更改的 kotlin 文件": "type:file ext:kt modified:<24h",
    "last 12 days lua files": "type:file ext:lua modified:<12d",
    "过去5天编辑的csv文件": "type:file ext:csv modified:<5d",
    "this week ruby files": "type:file ext:rb modified:<7d",
    "please find all folders for holiday": "type:directory holiday",
    "文件夹 照片": "type:directory 照片",
    "open the app calculator": "type:application calculator",
    "nonsense:thing kotlin": "nonsense:thing kotlin",
    "limit:99999": "limit:2000",
    "limit:0": "limit:1",
    "downtime": "downtime",
    "bookshelf": "bookshelf",
    "kotlin": "kotlin",
    "css": "type:file ext:cs",
    "docs": "type:file ext:doc",
    "logs": "type:file ext:log",
    "音乐 mp3": "type:file ext:mp3",
    "services": "type:service",
    "服务器": "器",
    "c++ files": "type:file ext:cpp",
    "modified:<2024": "modified:<2024s",
    "modified:>=24h": "modified:>24h",
    "modified:>=7": "modified:>=0007-01-01",
    "modified:>=2024-02-31": "modified:>=2024-03-02",
    "created:<=2024/01": "created:<=2024-01-01",
    "size:10mb": "size:>=10mb",
    "size:==1.5kb": "size:=1536b",
    "size:10m": "size:10m",
    "modified:=24h": ":=24h",
    'path:"My Projects" a': 'path:"My Projects" a',
    "ext:.pdf,toml": "ext:pdf ext:toml",
    "type:bogus": "type:bogus",
    "exact:yes word": "word",
    "sort:size sort:name:asc": "sort:name-asc",
    "visible:shown pid:12 user:me state:auto drive:c:": "visible:true pid:12 user:me state:auto drive:c",
}


@pytest.mark.parametrize("line", PAIRS)
def test_compiles_to(line):
    assert compile_detailed(line).query.to_dsl() == PAIRS[line]


@pytest.mark.parametrize("line", [x for x in PAIRS if ":" in x])
def test_canonical_form_is_stable(line):
    once = compile_detailed(line).query
    if compile_detailed(line).source == "dsl":
        assert compile_detailed(once.to_dsl()).query.to_dsl() == once.to_dsl()


def test_sources_and_notes():
    assert compile_detailed("ext:rs").source == "dsl"
    assert compile_detailed("find code").source == "natural-language"
    assert compile_detailed("zebra").source == "plain-text"
    assert compile_detailed("ext:rs bogus:1").notes[0] == "ignored unknown keys: bogus:1"
    assert compile_detailed("").query == SearchQuery()


def test_tokens_and_quotes():
    assert split_tokens('a  "b c" path:"d e"f "open end') == ["a", '"b c"', 'path:"d e"f', '"open end']
    got = parse(r"C:\x 12:30 name:")
    assert got.unknown_keys == (r"C:\x",) and not got.structured and got.query.text == r"C:\x 12:30 name:"


def test_overrides():
    got = compile_query("ext:rs sort:name-asc limit:5", types=("file",), limit=7, sort=Sort("size"), filters=(Filter("drive", "C"),))
    assert got.to_dsl() == "type:file ext:rs drive:C sort:size-desc limit:7"
    assert compile_query("limit:5").limit == 5
    built = SearchQuery.plain(" a ").with_types("file").with_filter("size", SizeBound(">", 1024)).with_sort("name", "asc").with_limit(9999)
    assert built.to_dsl() == "type:file size:>1kb sort:name-asc a limit:2000"


def test_json_filters():
    got = filters_from_json({"extension": ".rs", "drive": "cd", "pid": 4})
    assert got == [Filter("ext", "rs"), Filter("drive", "c"), Filter("pid", 4)]
    for bad in ({"size": "1"}, {"pid": -1}, {"pid": "4"}, {"name": " "}):
        with pytest.raises(QueryError) as e:
            filters_from_json(bad)
        assert e.value.code == "invalid-filter" and e.value.hint


@pytest.mark.parametrize(
    ("text", "ms"), [("30s", 30_000), ("1.5h", 5_400_000), ("2 weeks", 1_209_600_000), ("7", 7000), ("5x", None), ("", None), ("1.2.3s", None), ("-1s", None)]
)
def test_durations(text, ms):
    assert clock.parse_duration(text) == ms


def test_sizes_and_dates():
    assert [clock.parse_size(x) for x in ("1k", "1.5kb", "2gb", "3m", "7 bytes", "b")] == [1024, 1536, 2 << 30, None, 7, None]
    assert [clock.format_size(n) for n in (0, 1023, 1024, 5 << 20, 3 << 40)] == ["0b", "1023b", "1kb", "5mb", "3tb"]
    assert [clock.format_duration(n * 1000) for n in (86400, 172800, 3600, 90, 120)] == ["24h", "2d", "1h", "90s", "2m"]
    assert clock.parse_date("1970-01-02") == clock.DAY_MS and clock.parse_date("2024-13-01") is None and clock.parse_date("x") is None
    for text in ("0007-03-01", "1600-02-29", "1969-12-31", "2024-02-29", "9999-12-31"):
        assert clock.format_date(clock.parse_date(text)) == text
    assert TimeBound("older", 3_600_000).to_dsl() == ">1h"
