"""Parents of what the journal creates: the parent that is alive at that moment, else the drive's root, else none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import shared_dir

#: Directories within directories of one batch, on drives without a root, that are followed.
MOST_ROUNDS = 256


def lives(files: DataFrame, happened: DataFrame) -> DataFrame:
    """file_id, is_dir, born, gone: when each file is alive, in usns; born is null if it was before, gone if it still is."""
    own = happened.groupBy("file_id", "life").agg(
        F.max(F.when(F.col("op") == "create", F.col("usn"))).alias("born"),
        F.max(F.when(F.col("op") == "delete", F.col("usn"))).alias("gone"),
    )
    first = own.where("life = 0").select("file_id", "gone")
    before = files.where("NOT is_deleted AND file_id <> 0").select("file_id").join(first, "file_id", "left")
    before = before.select("file_id", F.lit(None).cast("long").alias("born"), "gone")
    return before.union(own.where("life > 0 AND file_id <> 0").select("file_id", "born", "gone"))


def found_in(creations: DataFrame, alive: DataFrame) -> DataFrame:
    """creations with found: the parent if it is alive when they come."""
    alive = alive.select(F.col("file_id").alias("__p"), "born", "gone")
    at = F.col("usn")
    fits = (F.col("parent_file_id") == F.col("__p")) & (F.col("born").isNull() | (F.col("born") < at)) & (F.col("gone").isNull() | (F.col("gone") > at))
    return creations.join(alive, fits, "left").withColumn("found", F.col("__p")).drop("__p", "born", "gone")


def resolved(files: DataFrame, mutations: DataFrame, effective) -> DataFrame:
    """The mutations, with parent_id for creations; creations that have no parent are left out.

    files: file_id, drive, is_dir, is_root, is_deleted; mutations: usn, op, file_id, parent_file_id, drive. ``effective``
    tells which mutations change something. Only creations on drives without a root wait for a parent that the batch
    itself may create: they are settled in rounds, a level of such directories each, mostly none.
    """
    roots = files.where("is_root").groupBy(F.upper("drive").alias("__drive")).agg(F.min("file_id").alias("root"))
    rows = mutations.where("file_id <> 0 OR op = 'create'").join(
        F.broadcast(roots), F.upper("drive") == F.col("__drive"), "left"
    ).drop("__drive")
    create = F.col("op") == "create"
    waiting = rows.where(create & F.col("root").isNull())
    sure = rows.where(~create | F.col("root").isNotNull())
    made_by_waiting = F.col("parent_file_id") == F.col("__w")
    new = waiting.select(F.col("file_id").alias("__w")).distinct()
    if not rows.where(create).join(new, made_by_waiting, "left_semi").limit(1).count():
        # Mostly: no parent hangs on a creation that waits, so all are told at once.
        made = found_in(rows.where(create), lives(files, effective(files, sure)))
        made = made.withColumn("parent_id", F.coalesce("found", "root")).where("parent_id IS NOT NULL").drop("found", "root")
        return rows.where(~create).drop("root").withColumn("parent_id", F.lit(None).cast("long")).unionByName(made)
    count = 0
    accepted = waiting.limit(0).select("usn")
    for _ in range(MOST_ROUNDS):
        now = sure.unionByName(waiting.join(accepted, "usn", "left_semi"))
        more = found_in(waiting, lives(files, effective(files, now))).where("found IS NOT NULL").select("usn")
        # The usns of one batch's waiting creations that are accepted, written, so that plans stay small.
        more = _cut(more.distinct())
        n = more.count()
        if n == count:
            break
        accepted, count = more, n
    else:
        raise RuntimeError(f"directories of a batch are nested more than {MOST_ROUNDS} deep")
    rows = sure.unionByName(waiting.join(accepted, "usn", "left_semi")) if count else sure
    made = found_in(rows.where(create), lives(files, effective(files, rows)))
    made = made.withColumn("parent_id", F.coalesce("found", "root")).drop("found", "root")
    return rows.where(~create).drop("root").withColumn("parent_id", F.lit(None).cast("long")).unionByName(made)


def _cut(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/lodestone/accepted-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
