import pytest

from lodestone.sources import cache, walk


@pytest.fixture
def folder(tmp_path):
    for name in ("notes/alpha-report.pdf", "notes/bravo-notes.txt", "src/main.rs", "node_modules/x/y.js", "Temp/z.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 16)
    (tmp_path / "empty-folder").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "src")
    return tmp_path


def test_walk_source(spark, folder):
    spark.dataSource.register(walk.WalkSource)
    rows = {r["name"]: r for r in spark.read.format("walk").option("roots", f"{folder}/notes;{folder}").load().collect()}
    assert set(rows) == {"notes", "alpha-report.pdf", "bravo-notes.txt", "src", "main.rs", "empty-folder", "link"}
    assert rows["main.rs"]["size"] == 16 and rows["src"]["is_dir"] and not rows["link"]["is_dir"] and rows["main.rs"]["modified"] > 0
    few = spark.read.format("walk").option("roots", str(folder)).option("maxEntries", "3").load().collect()
    assert len(few) == 4 and few[-1]["truncated"] and not any(r["truncated"] for r in few[:-1])
    own = spark.read.format("walk").option("roots", str(folder)).option("exclude", "SRC;notes").load()
    assert "z.txt" in {r["name"] for r in own.collect()} and own.where("name = 'main.rs'").count() == 0


def test_exclusions():
    assert walk.excluded("Node_Modules", "/a/Node_Modules") and walk.excluded("x", "C:/Users/me/AppData/Local/Temp/x")
    assert not walk.excluded("src", "/a/src")


def test_cache(spark, tmp_path):
    root = str(tmp_path / "t")
    assert cache.load(spark, root) is None
    cache.write_version(spark.range(3).toDF("a"), root, saved_at=1000)
    cache.write_version(spark.range(5).toDF("a"), root, saved_at=2000)
    assert cache.load(spark, root).count() == 5 and cache.age_ms(spark, root, 2500) == 500
    for pointer in (tmp_path / "t").glob("pointer-*"):
        pointer.write_text('{"schema": 2, "version": "v"}')
    assert cache.load(spark, root) is None
    assert cache.remove(spark, root) and not (tmp_path / "t").exists()
