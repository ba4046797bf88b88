"""Tables that outlive a session: folders of Parquet and numbered pointers, through Hadoop's file systems.

A version is a base and the deltas since it. Folders are written whole before a new pointer names them, pointers are
never overwritten, and the highest one that can be read counts, so a crash at any moment leaves the table as it was or
as it is to be. Missing, broken or older pointers mean: rebuild. What only older pointers name is removed.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION, POINTER = 4, "pointer-{:012d}.json"
#: Pointers that stay beside the current one, for readers that hold them; deltas after which a table is written anew.
OLD_POINTERS, MOST_DELTAS = 2, 20


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, root: str) -> list[str]:
    fs, where = _fs(spark, root)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _read(spark: SparkSession, root: str, name: str) -> dict | None:
    fs, where = _fs(spark, f"{root}/{name}")
    try:
        stream = fs.open(where)
        try:
            found = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    except (ValueError, Py4JJavaError):  # not JSON, a checksum that fails, or gone
        return None
    return found if isinstance(found, dict) and found.get("schema") == SCHEMA_VERSION else None


def _pointers(names: list[str]) -> list[int]:
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"pointer-(\d{12})\.json", n)))


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The current pointer, or None if there is none that can be read, of this schema version."""
    for number in reversed(_pointers(_names(spark, root))):
        if found := _read(spark, root, POINTER.format(number)):
            return {**found, "number": number}
    return None


def _point(spark: SparkSession, root: str, parts: list[str], batch_id: int, saved_at: int) -> None:
    names = _names(spark, root)
    numbers = _pointers(names)
    number = numbers[-1] + 1 if numbers else 0
    fs, where = _fs(spark, f"{root}/{POINTER.format(number)}")
    out = fs.create(where, False)
    out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "parts": parts, "batch_id": batch_id, "saved_at": saved_at}).encode()))
    out.close()
    kept = numbers[-OLD_POINTERS:] if OLD_POINTERS else []
    used = set(parts)
    for n in kept:
        used |= set((_read(spark, root, POINTER.format(n)) or {}).get("parts", ()))
    for n in numbers:
        if n not in kept:
            _remove(spark, f"{root}/{POINTER.format(n)}")
    for name in names:
        if name.startswith("v-") and name not in used:
            _remove(spark, f"{root}/{name}")


def _remove(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.delete(where, True)


def _write(df: DataFrame, root: str) -> str:
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    return version


def write_version(df: DataFrame, root: str, batch_id: int = -1, saved_at: int = 0) -> str:
    """Writes df as the new version of the table at root and points to it."""
    version = _write(df, root)
    _point(df.sparkSession, root, [version], batch_id, saved_at)
    return version


def write_delta(changed: DataFrame, root: str, key: str, batch_id: int, saved_at: int = 0) -> None:
    """Adds rows that replace all rows of their keys. Every MOST_DELTAS deltas the table is written anew."""
    spark = changed.sparkSession
    now = read_pointer(spark, root)
    parts = [*now["parts"], _write(changed, root)]
    if len(parts) > MOST_DELTAS:
        parts = [_write(_merged(spark, root, parts, key, changed.schema), root)]
    _point(spark, root, parts, batch_id, saved_at)


def _merged(spark: SparkSession, root: str, parts: list[str], key: str, schema: StructType | None) -> DataFrame:
    """The base without the deltas' keys, and of these the rows of the last delta that has them."""
    reader = spark.read.schema(schema) if schema else spark.read
    tables = [reader.parquet(f"{root}/{p}") for p in parts]
    if len(tables) == 1:
        return tables[0]
    deltas = reduce(DataFrame.unionByName, (t.withColumn("__part", F.lit(n)) for n, t in enumerate(tables[1:])))
    last = deltas.groupBy(F.col(key).alias("__key")).agg(F.max("__part").alias("__last"))
    newest = deltas.join(last, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__last")), "left_semi").drop("__part")
    return tables[0].join(last, F.col(key) == F.col("__key"), "left_anti").unionByName(newest)


def load(spark: SparkSession, root: str, schema: StructType | None = None, key: str = "file_id") -> DataFrame | None:
    """The current version, or None: rebuild."""
    now = read_pointer(spark, root)
    return None if now is None else _merged(spark, root, now["parts"], key, schema)


def age_ms(spark: SparkSession, root: str, now: int) -> int | None:
    found = read_pointer(spark, root)
    return None if found is None else now - found["saved_at"]


def remove(spark: SparkSession, root: str) -> bool:
    return _remove(spark, root)
