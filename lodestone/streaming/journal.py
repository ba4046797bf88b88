"""The change journal: records to mutations, mutations to the file table, and each volume's cursor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.streaming.resolve import resolved

# The reason bits of a journal record.
DATA_CHANGED = 0x1 | 0x2 | 0x4
CREATED, DELETED, RENAMED_NEW = 0x100, 0x200, 0x2000
STATUSES = ("healthy", "catching-up", "rebuild-required", "unavailable", "disabled", "unknown")


def operation(reason: Column) -> Column:
    """delete over create over rename over metadata; null for reasons that change nothing."""

    def bit(mask: int) -> Column:
        return reason.bitwiseAND(F.lit(mask)) != 0

    return (
        F.when(bit(DELETED), "delete")
        .when(bit(CREATED), "create")
        .when(bit(RENAMED_NEW), "rename")
        .when(bit(DATA_CHANGED), "metadata")
    )


def effective(files: DataFrame, mutations: DataFrame) -> DataFrame:
    """mutations(usn, op, file_id, ...) that change something, with the life of the file that they change.

    Life 0 is the row that files has alive; each creation of a file that is not alive begins another. A creation of a
    live file, and anything else of a dead or unknown one, does nothing. File 0 stands for files without a number: each
    creation is one of its own, and nothing finds it again.
    """
    known = files.where("NOT is_deleted AND file_id <> 0").select("file_id", F.lit(True).alias("known"))
    before = Window.partitionBy("file_id").orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file_id").orderBy("usn").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("op").isin("create", "delete"), F.col("op") == "create")
    alive = F.coalesce(F.last(turn, ignorenulls=True).over(before), F.col("known"), F.lit(False)) & (F.col("file_id") != 0)
    return (
        mutations.join(known, "file_id", "left")
        .withColumn("alive", alive)
        .where(F.col("alive") != (F.col("op") == "create"))
        .withColumn("life", F.count(F.when(F.col("op") == "create", 1)).over(upto))
        .drop("known", "alive")
    )


def happening(files: DataFrame, mutations: DataFrame) -> DataFrame:
    """effective() of the mutations whose creations have a parent, with parent_id."""
    return effective(files, resolved(files, mutations, effective))


#: Columns of the file table and of mutations.
FILES = "file_id long, parent_id long, name string, drive string, is_dir boolean, is_root boolean, size long, modified_ms long, is_deleted boolean"
MUTATIONS = "usn long, op string, file_id long, parent_file_id long, name string, drive string, is_directory boolean, size long, modified_ms long"


def apply_batch(files: DataFrame, mutations: DataFrame, touched: bool = False) -> DataFrame:
    """The file table (FILES) after mutations (MUTATIONS).

    A creation stands below its parent if that is alive, else below its drive's root, else it is left out. A rename
    changes the name only; metadata without a size or with modified 0 keeps what was, and a directory's size stays; a
    deletion leaves a tombstone, which children may still name. A mutation of the same usn that comes again finds its
    work done. touched: only the rows of files that the batch names.
    """
    happened = happening(files, mutations)
    create = F.col("op") == "create"
    born = F.when(create, F.col("usn"))
    named = F.when(F.col("op").isin("create", "rename"), F.col("usn"))
    sized = F.when((F.col("op") == "metadata") & F.col("size").isNotNull(), F.col("usn"))
    dated = F.when(F.col("op").isin("create", "metadata") & (F.coalesce("modified_ms", F.lit(0)) != 0), F.col("usn"))
    last = happened.groupBy("file_id", "life").agg(
        F.max_by("name", named).alias("new_name"),
        F.max_by("size", born).alias("born_size"),
        F.max_by("size", sized).alias("new_size"),
        F.max_by("modified_ms", dated).alias("new_modified"),
        F.max_by(F.struct("parent_id", "drive", "is_directory"), born).alias("made"),
        F.bool_or(F.col("op") == "delete").alias("gone"),
    )
    if touched:
        files = files.join(mutations.select("file_id").distinct(), "file_id", "left_semi")
    old = files.join(last.where("life = 0").drop("life", "made", "born_size"), "file_id", "left")
    dead = F.coalesce(F.col("is_deleted"), F.lit(False))

    def now(name: str, new: str, stays=dead) -> Column:
        return F.when(stays, F.col(name)).otherwise(F.coalesce(new, name)).alias(name)

    old = old.select(
        "file_id", "parent_id", now("name", "new_name"), "drive", "is_dir", "is_root",
        now("size", "new_size", dead | F.coalesce("is_dir", F.lit(False))).cast("long").alias("size"),
        now("modified_ms", "new_modified"),
        (dead | F.coalesce("gone", F.lit(False))).alias("is_deleted"),
    )
    directory = F.coalesce("made.is_directory", F.lit(False))
    new = last.where("life > 0").select(
        "file_id", "made.parent_id", F.col("new_name").alias("name"), F.upper("made.drive").alias("drive"), directory.alias("is_dir"), F.lit(False).alias("is_root"),
        F.when(directory, 0).otherwise(F.coalesce("new_size", "born_size", F.lit(0))).cast("long").alias("size"),
        F.coalesce("new_modified", F.lit(0)).cast("long").alias("modified_ms"),
        F.col("gone").alias("is_deleted"),
    )
    return old.unionByName(new)


def report(files: DataFrame, mutations: DataFrame) -> DataFrame:
    """How many mutations of each kind took effect, and how many did not."""
    done = happening(files, mutations).groupBy("op").agg(F.count("*").alias("applied"))
    seen = mutations.groupBy("op").agg(F.count("*").alias("seen"))
    return seen.join(done, "op", "left").select(
        "op", F.coalesce("applied", F.lit(0)).alias("applied"), (F.col("seen") - F.coalesce("applied", F.lit(0))).alias("skipped")
    )


@dataclass(frozen=True)
class Identity:
    """What a volume says of itself; its id stays when its drive letter changes."""

    volume_id: str
    mount_points: tuple[str, ...] = ()
    file_system: str = ""
    serial: int = 0


@dataclass(frozen=True)
class Cursor:
    """What is remembered of a volume."""

    volume_id: str
    journal_id: int | None = None
    usn: int | None = None
    rebuild: bool = False
    status: str = "unknown"
    lag: int = 0
    identity: Identity | None = None
    why: str = ""


def register(state: Cursor | None, identity: Identity) -> Cursor:
    """The state with what the identity says now; the cursor stays, and a serial of 0 does not replace one that is known."""
    was = state or Cursor(identity.volume_id)
    serial = identity.serial or (was.identity.serial if was.identity else 0)
    return replace(was, identity=replace(identity, serial=serial))


def reconcile(state: Cursor | None, identity: Identity) -> tuple[Cursor | None, str]:
    """Whether an identity is that of the volume that is remembered: same, serial-changed or unknown."""
    if state is None:
        return None, "unknown"
    known = state.identity.serial if state.identity else 0
    kept = replace(identity, serial=known or identity.serial)
    changed = bool(known and identity.serial and known != identity.serial)
    return replace(state, identity=kept), "serial-changed" if changed else "same"


def require_rebuild(state: Cursor, why: str) -> Cursor:
    """The cursor is given up, and the next reading asks for a rebuild, once."""
    return replace(state, rebuild=True, usn=None, status="rebuild-required", lag=0, why=why)


def invalidate_all(states: dict[str, Cursor], why: str) -> dict[str, Cursor]:
    return {v: require_rebuild(s, why) for v, s in states.items()}


def observe(state: Cursor | None, volume_id: str, journal_id: int, first: int, next_: int) -> tuple[Cursor, str, str, int, int]:
    """The state after a reading of the journal and what to do: decision (rebuild, up-to-date, incremental), reason, from, to."""
    was = state or Cursor(volume_id)
    reason = (
        "new-volume" if state is None
        else "requested" if was.rebuild
        else "no-cursor" if was.usn is None
        else "journal-recreated" if was.journal_id != journal_id
        else "journal-rolled-over" if was.usn < first
        else "cursor-ahead" if was.usn > next_
        else ""
    )
    if reason:
        now = replace(was, journal_id=journal_id, rebuild=False, status="rebuild-required", lag=0, why=was.why if reason == "requested" else reason)
        return now, "rebuild", reason, 0, 0
    if was.usn == next_:
        return replace(was, status="healthy", lag=0), "up-to-date", "", next_, next_
    return replace(was, status="catching-up", lag=next_ - was.usn), "incremental", "", was.usn, next_


def advance(state: Cursor, usn: int, next_: int) -> Cursor:
    """The cursor moved to usn; healthy once it has caught up."""
    return replace(state, usn=usn, status="healthy" if usn >= next_ else "catching-up", lag=max(0, next_ - usn))


DECISIONS = "volume_id string, seq long, decision string, reason string, from_usn long, to_usn long, status string, lag long"
DECIDED = [c.split()[0] for c in DECISIONS.split(", ")]


def fold_volume(volume_id: str, state: Cursor | None, readings: pd.DataFrame) -> tuple[Cursor | None, list[tuple]]:
    """Readings in order of seq; after each the cursor stands at its applied_usn."""
    out = []
    for r in readings.sort_values("seq").itertuples():
        state, decision, reason, start, end = observe(state, volume_id, int(r.journal_id), int(r.first_usn), int(r.next_usn))
        state = advance(state, int(r.applied_usn), int(r.next_usn))
        out.append((volume_id, int(r.seq), decision, reason, start, end, state.status, state.lag))
    return state, out


def decisions(readings: DataFrame) -> DataFrame:
    """readings(volume_id, seq, journal_id, first_usn, next_usn, applied_usn) -> a decision each, from no state.

    applied_usn is how far the reading was applied, so the cursor before one is the reading before's; this needs a window,
    no loop. A volume is healthy once all is applied.
    """
    w = Window.partitionBy("volume_id").orderBy("seq")
    was, was_id = F.lag("applied_usn").over(w), F.lag("journal_id").over(w)
    reason = (
        F.when(was.isNull(), "new-volume")
        .when(was_id != F.col("journal_id"), "journal-recreated")
        .when(was < F.col("first_usn"), "journal-rolled-over")
        .when(was > F.col("next_usn"), "cursor-ahead")
        .otherwise("")
    )
    decision = F.when(reason != "", "rebuild").when(was == F.col("next_usn"), "up-to-date").otherwise("incremental")
    rebuilt = reason != ""
    return readings.select(
        "volume_id",
        "seq",
        decision.alias("decision"),
        reason.alias("reason"),
        F.when(rebuilt, 0).otherwise(was).cast("long").alias("from_usn"),
        F.when(rebuilt, 0).otherwise(F.col("next_usn")).cast("long").alias("to_usn"),
        F.when(F.col("applied_usn") >= F.col("next_usn"), "healthy").otherwise("catching-up").alias("status"),
        F.greatest(F.lit(0), F.col("next_usn") - F.col("applied_usn")).cast("long").alias("lag"),
    )


STATE = "journal_id long, usn long, rebuild boolean, status string"


def follow(readings: DataFrame) -> DataFrame:
    """decisions() over a stream of readings; a volume's cursor is the query's state, and its checkpoint survives failures."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Cursor(key[0], *state.get[:2], rebuild=bool(state.get[2]), status=state.get[3]) if state.exists else None
        now, out = fold_volume(key[0], now, pd.concat(list(batches)))
        if now is not None:
            state.update((now.journal_id, now.usn, now.rebuild, now.status))
        yield pd.DataFrame(out, columns=DECIDED)

    return readings.groupBy("volume_id").applyInPandasWithState(step, DECISIONS, STATE, "append", "NoTimeout")


def changes(decided: DataFrame, since: int, most: int = 500) -> DataFrame:
    """Advances of the cursor beyond ``since``, oldest first; the limit is the feed's page."""
    moved = decided.where((F.col("decision") == "incremental") & (F.col("to_usn") > since))
    return moved.orderBy("to_usn", "volume_id").limit(most)


def totals(decided: DataFrame) -> DataFrame:
    """For each volume its readings, rebuilds, last position, status and lag, whether it was always healthy, and its mutations."""
    moved = F.when(F.col("decision") == "incremental", F.col("to_usn") - F.col("from_usn"))
    return decided.groupBy("volume_id").agg(
        F.count("*").alias("readings"),
        F.count_if(F.col("decision") == "rebuild").alias("rebuilds"),
        F.max_by("to_usn", "seq").alias("last_to"),
        F.max_by("status", "seq").alias("status"),
        F.max_by("lag", "seq").alias("lag"),
        F.bool_and(F.col("status") == "healthy").alias("all_healthy"),
        F.coalesce(F.sum(moved), F.lit(0)).alias("mutations"),
    )


def entries(readings: DataFrame) -> DataFrame:
    """volume_id, entries: as the last reading has them."""
    return readings.groupBy("volume_id").agg(F.max_by("entries", "seq").alias("entries"))


def _degraded() -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("status") != "healthy", F.col("volume_id")))).alias("degraded")


def registry(volumes: DataFrame, counted: DataFrame) -> DataFrame:
    """One row over all volumes: total_entries, all_healthy and the list of those that are not."""
    return volumes.join(counted, "volume_id").agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"),
        F.coalesce(F.bool_and(F.col("status") == "healthy"), F.lit(True)).alias("all_healthy"),
        _degraded(),
    )


def supervisor(volumes: DataFrame) -> DataFrame:
    """One row over the workers, one a volume: how many, all_healthy (not if there is none), degraded, total_mutations."""
    return volumes.agg(
        F.count("*").alias("workers"),
        F.coalesce(F.bool_and(F.col("status") == "healthy"), F.lit(False)).alias("all_healthy"),
        _degraded(),
        F.coalesce(F.sum("mutations"), F.lit(0)).alias("total_mutations"),
    )
