import random

import pytest

from lodestone.sources import cache
from lodestone.streaming import journal, tail

FILES, MUTATIONS = journal.FILES, journal.MUTATIONS


def folded(files, mutations):
    """One mutation after the other."""
    names = [f.split()[0] for f in FILES.split(", ")]
    rows = [dict(zip(names, f)) for f in files]
    live = lambda i: next((r for r in rows if i and r["file_id"] == i and not r["is_deleted"]), None)
    done = 0
    for _, op, file_id, parent, name, drive, is_dir, size, modified in sorted(mutations):
        row = live(file_id)
        if op == "create" and row is None:
            above = live(parent) or next((r for r in rows if r["is_root"] and r["drive"] == drive), None)
            if above:
                rows.append(dict(zip(names, (file_id, above["file_id"], name, drive, is_dir, False, 0 if is_dir else size or 0, modified or 0, False))))
                done += 1
        elif row and op != "create":
            done += 1
            if op == "delete":
                row["is_deleted"] = True
            elif op == "rename":
                row["name"] = name
            else:
                row["size"] = row["size"] if size is None or row["is_dir"] else size
                row["modified_ms"] = modified or row["modified_ms"]
    return sorted((tuple(r.values()) for r in rows), key=repr), done


def sample(seed):
    """Files below directories on drive C, which has a root; D has none, so that what is made there needs its parent."""
    rng = random.Random(seed)
    files = [(900, None, "C:\\", "C", True, True, 0, 0, False)]
    files += [(i, 900, f"f{i}", "C", i % 4 == 0, False, 0 if i % 4 == 0 else 10 * i, 5, i % 5 == 4) for i in range(1, 20)]
    mutations = [
        (usn, rng.choice(["create", "create", "delete", "rename", "metadata"]), rng.randrange(30), rng.randrange(34), f"n{usn}", rng.choice("CDD"),
         rng.random() < 0.4, rng.choice([None, usn]), rng.choice([0, usn + 1000]))
        for usn in range(400)
    ]
    return files, mutations


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_a_fold(spark, seed):
    files, mutations = sample(seed)
    after = journal.apply_batch(spark.createDataFrame(files, FILES), spark.createDataFrame(mutations, MUTATIONS))
    want, done = folded(files, mutations)
    assert rows_of(after) == want
    counts = {r["op"]: (r["applied"], r["skipped"]) for r in journal.report(spark.createDataFrame(files, FILES), spark.createDataFrame(mutations, MUTATIONS)).collect()}
    assert sum(a + s for a, s in counts.values()) == 400 and sum(a for a, _ in counts.values()) == done


def test_parents_that_the_batch_makes(spark):
    """On a drive without a root: a chain of new directories counts if its first has a parent, and else not at all."""
    files = [(1, None, "C:\\", "C", True, True, 0, 0, False), (2, 1, "there", "D", True, False, 0, 0, False)]
    chain = [(10 + i, "create", 100 + i, 99 + i if i else 2, f"d{i}", "D", True, 0, 0) for i in range(6)]
    orphans = [(50 + i, "create", 200 + i, 199 + i, f"o{i}", "D", True, 0, 0) for i in range(3)]
    late = [(90, "create", 300, 301, "before its parent", "D", False, 1, 0), (91, "create", 301, 2, "parent", "D", True, 0, 0), (92, "create", 302, 77, "top", "c", False, 3, 0)]
    after = journal.apply_batch(spark.createDataFrame(files, FILES), spark.createDataFrame(chain + orphans + late, MUTATIONS))
    got = {r["file_id"]: r["parent_id"] for r in after.collect()}
    assert got == {1: None, 2: 1, 100: 2, 101: 100, 102: 101, 103: 102, 104: 103, 105: 104, 301: 2, 302: 1}


def test_a_crash_between_the_table_and_its_pointer(spark, tmp_path):
    """What was written without a pointer is not there; a broken pointer is none; old versions go."""
    root = str(tmp_path / "table")
    frame = lambda n: spark.createDataFrame([(i, n) for i in range(3)], "file_id long, n int")
    cache.write_version(frame(0), root)
    cache._write(frame(1), root)
    assert {r["n"] for r in cache.load(spark, root).collect()} == {0}
    (tmp_path / "table" / "pointer-000000000009.json").write_text('{"schema": 4, "par')
    assert {r["n"] for r in cache.load(spark, root).collect()} == {0}
    for n in range(2, 6):
        cache.write_version(frame(n), root)
    assert {r["n"] for r in cache.load(spark, root).collect()} == {5}
    assert len(list((tmp_path / "table").glob("v-*"))) == 1 + cache.OLD_POINTERS


def test_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_DELTAS", 3)
    root, want = str(tmp_path / "table"), {i: 0 for i in range(10)}
    schema = "file_id long, n int"
    cache.write_version(spark.createDataFrame(list(want.items()), schema), root)
    for batch in range(1, 7):
        rows = {i: batch for i in (batch, batch + 3, 20 + batch)}
        want |= rows
        cache.write_delta(spark.createDataFrame(list(rows.items()), schema), root, "file_id", batch)
        assert dict(map(tuple, cache.load(spark, root).collect())) == want
        assert len(cache.read_pointer(spark, root)["parts"]) <= 3


def test_stream_equals_batch_and_replay_does_nothing(spark, tmp_path):
    files, mutations = sample(3)
    root, source = str(tmp_path / "table"), str(tmp_path / "log")
    cache.write_version(spark.createDataFrame(files, FILES), root)
    for k in range(3):
        spark.createDataFrame(mutations[k * 100 : (k + 1) * 100], MUTATIONS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MUTATIONS).parquet(source)
        tail.tail(stream, root, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert rows_of(cache.load(spark, root)) == folded(files, mutations[:300])[0]
    again = spark.createDataFrame(mutations[200:300], MUTATIONS)
    assert tail.apply_version(spark, root, again, 2) is False
    assert rows_of(cache.load(spark, root)) == folded(files, mutations[:300])[0]
    with pytest.raises(FileNotFoundError):
        tail.apply_version(spark, str(tmp_path / "none"), again, 0)


CASES = [
    # state (journal, usn, rebuild), reading (journal, first, next), decision, reason, from, to
    (None, (7, 0, 100), "rebuild", "new-volume", 0, 0),
    ((7, 100, False), (7, 0, 250), "incremental", "", 100, 250),
    ((7, 100, True), (7, 0, 250), "rebuild", "requested", 0, 0),
    ((7, None, False), (7, 0, 250), "rebuild", "no-cursor", 0, 0),
    ((7, 100, False), (8, 0, 250), "rebuild", "journal-recreated", 0, 0),
    ((7, 100, False), (7, 150, 250), "rebuild", "journal-rolled-over", 0, 0),
    ((7, 300, False), (7, 0, 250), "rebuild", "cursor-ahead", 0, 0),
    ((7, 250, False), (7, 0, 250), "up-to-date", "", 250, 250),
]


@pytest.mark.parametrize("case", CASES)
def test_cursor(case):
    was, (journal_id, first, next_), decision, reason, start, end = case
    state = journal.Cursor("v", was[0], was[1], rebuild=was[2]) if was else None
    now, *got = journal.observe(state, "v", journal_id, first, next_)
    assert tuple(got) == (decision, reason, start, end) and not now.rebuild
    assert journal.advance(now, next_, next_).status == "healthy" and journal.advance(now, first, next_ + 1).status == "catching-up"


def test_followed_stream_equals_decisions(spark, tmp_path):
    rng = random.Random(4)
    rows, usn = [], {}
    for seq in range(200):
        v = f"v{rng.randrange(3)}"
        usn[v] = max(0, usn.get(v, 0) + rng.choice([0, 5, 50, -20]))
        rows.append((v, seq, rng.choice([7, 7, 7, 7, 8]), rng.choice([0, 0, 30]), usn[v], usn[v] - rng.choice([0, 0, 4])))
    schema = "volume_id string, seq long, journal_id long, first_usn long, next_usn long, applied_usn long"
    path = str(tmp_path / "readings")
    for k in range(2):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(path)
    stream = journal.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = journal.decisions(spark.createDataFrame(rows, schema))
    assert len(spark.table("decided").collect()) == 200
    assert spark.table("decided").exceptAll(want).count() == 0


def test_identities():
    """A cursor outlives a change of the drive's letter; another serial is told, and one that is not known is none."""
    first = journal.register(None, journal.Identity("v", ("C:",), "NTFS", 5))
    at = journal.advance(journal.Cursor("v", 7, 0, identity=first.identity), 90, 90)
    moved = journal.register(at, journal.Identity("v", ("E:",), "NTFS", 0))
    assert (moved.usn, moved.identity.mount_points, moved.identity.serial) == (90, ("E:",), 5)
    assert journal.reconcile(moved, journal.Identity("v", ("F:",), "NTFS", 5))[1] == "same"
    assert journal.reconcile(moved, journal.Identity("v", ("F:",), "NTFS", 6))[1] == "serial-changed"
    assert journal.reconcile(moved, journal.Identity("v"))[1] == "same" and journal.reconcile(None, journal.Identity("v"))[1] == "unknown"


def test_a_rebuild_that_is_asked_for_comes_once():
    states = journal.invalidate_all({v: journal.Cursor(v, 7, 50, status="healthy") for v in "ab"}, "asked")
    assert all(s.rebuild and s.usn is None and s.status == "rebuild-required" for s in states.values())
    now, decision, reason, *_ = journal.observe(states["a"], "a", 7, 0, 60)
    assert (decision, reason, now.why) == ("rebuild", "requested", "asked")
    now = journal.advance(now, 60, 60)
    assert journal.observe(now, "a", 7, 0, 60)[1] == "up-to-date" and now.status == "healthy"


def test_roll_ups_of_nothing(spark):
    none = journal.decisions(spark.createDataFrame([], "volume_id string, seq long, journal_id long, first_usn long, next_usn long, applied_usn long"))
    row = journal.supervisor(journal.totals(none)).first()
    assert (row["workers"], row["all_healthy"], row["degraded"], row["total_mutations"]) == (0, False, [], 0)
