import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import clock, derive
from lodestone.functions import text as tx
from lodestone.plans import ranking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def spans(found):
    return [(r["start"], r["end"]) for r in found]


def test_tokens(spark):
    assert one(spark, tx.tokens_of(F.col("t")), t=r"D:\Projects\Code.exe") == ["d", "projects", "code", "exe"]
    assert one(spark, tx.has_token(F.col("t"), " CODE "), t="vs-code.exe") and not one(spark, tx.has_token(F.col("t"), "cod"), t="vs-code.exe")


@pytest.mark.parametrize(
    ("needle", "text", "want"),
    [("studio", "Visual Studio Code", [(7, 13)]), ("vsc", "Visual Studio Code", [(0, 1), (2, 3), (14, 15)]), ("zz", "abc", []), (" ", "abc", []),
     ("最近", "最近修改", [(0, 2)]), ("x", "İx", [(1, 2)]), ("ab", "xxAB", [(2, 4)])],
)
def test_match_ranges(spark, needle, text, want):
    assert spans(one(spark, tx.match_ranges(F.col("t"), needle), t=text)) == want


def test_fuzzy_by_hand():
    assert tx.fuzzy_match("最近", "最近修改的报告")[1] == [0, 1]
    assert tx.fuzzy_match("cv", "vc") is None and tx.fuzzy_match(" ", "x") == (0, [])
    # vsc in VsCode: 3 * 12, two neighbours 8 each, start 12, hump 6, density 25, no gaps.
    assert tx.fuzzy_match("vsc", "VsCode") == (36 + 16 + 12 + 6 + 25, [0, 1, 2])
    # a in "x a": 12, separator 10, two late -4, density 25.
    assert tx.fuzzy_match("a", "x a") == (12 + 10 - 4 + 25, [2])


def test_fuzzy_column_equals_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcABC-_ İ") for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("m", tx.fuzzy(F.col("t"), "aBc")).collect()
    for r in rows:
        want = tx.fuzzy_match("aBc", r["t"]) if r["t"] is not None else None
        assert (r["m"] and (r["m"]["score"], r["m"]["positions"])) == want


def test_merged_and_marked(spark):
    ranges = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(5, 7), (0, 2), (2, 3), (6, 9), (4, 4)]))
    assert spans(one(spark, tx.merged(ranges), t="x")) == [(0, 3), (5, 9)]
    assert one(spark, tx.marked(F.col("t"), tx.merged(ranges)), t="abcdefgh") == "[abc]de[fgh]"


def test_paths(spark):
    for path, ext, drive, name in [(r"c:\a.b\File.TXT", "TXT", "C", "File.TXT"), (r"\\srv\x\.git", None, None, ".git"), ("D:/x/y.tar.gz", "gz", "D", "y.tar.gz"),
                                   ("noext", None, None, "noext"), ("a.", None, None, "a."), ("C:\\dir\\", None, "C", "dir")]:
        got = [one(spark, f(F.col("p")), p=path) for f in (derive.extension_of, derive.drive_of, derive.file_name_of)]
        assert got == [ext, drive, name], path
    assert one(spark, derive.extension_of(F.col("p"), 3), p="a.jpeg") is None
    for raw, pretty in [("visual-studio-code", "Visual Studio Code"), ("Code.exe", "Code"), ("myAPP_v2.x", "MyAPP V2 X"), ("--", "--"), (".exe", "Exe")]:
        assert one(spark, derive.prettify(F.col("p")), p=raw) == pretty


def test_formats(spark):
    assert [one(spark, clock.human_size(F.col("n")), n=n) for n in (0, 1023, 1536, 5 << 30)] == ["0 B", "1023 B", "1.5 KB", "5.0 GB"]
    for n in (0, 1000, 1024, 3 << 20, 1 << 40):
        assert one(spark, clock.exact_size(F.col("n")), n=n) == clock.format_size(n)
    assert [one(spark, clock.age_text(F.col("n"), 10**12), n=10**12 - s * 1000) for s in (-5, 59, 60, 7200, 86400 * 3)] == ["just now", "just now", "1m ago", "2h ago", "3d ago"]
    assert one(spark, clock.filetime_ms(F.col("n")), n=116_444_736_000_000_000 + 15_000) == 1 and one(spark, clock.filetime_ms(F.col("n")), n=0) == 0


def test_recency_and_usage_bounds(spark):
    now = 10**12
    hour = 3_600_000
    values = [one(spark, ranking.recency(F.col("n"), now), n=now - h * hour) for h in (-3, 0, 1, 24, 8760, 99999)]
    assert values[:3] == [1.0, 1.0, 1.0] and 0 < values[3] < 1 and values[4:] == [0.0, 0.0]
    assert one(spark, ranking.usage_boost(F.col("n"), F.lit(9), F.lit(now), now), n=9) == pytest.approx(1.0)
    assert one(spark, ranking.usage_boost(F.col("n"), F.lit(9), F.lit(now - 30 * 24 * hour), now), n=9) == pytest.approx(0.5)
