"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import pickle
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import shared_dir

_WRITTEN: list[tuple[SparkSession, str, DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut of the lineage that outlives any executor.

    The table is removed by dropped(), by forget_tables(), which a long session calls between jobs, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append((spark, path, table))
    return table


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is not None and jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, as their successors are written.

    Spark removes a job's shuffle files once its plan is garbage, which may take long if memory is plenty, so collect it.
    """
    spent = None
    for at in reversed(range(len(_WRITTEN))):
        spark, path, table = _WRITTEN[at]
        if any(table is t for t in tables):
            del _WRITTEN[at]
            _remove(spark, path)
            spent = spark
    if spent is not None:
        gc.collect()
        spent.sparkContext._jvm.System.gc()


def forget_tables() -> None:
    """Removes all tables that written() has made; results that are not yet written out cannot be read afterwards."""
    while _WRITTEN:
        spark, path, _ = _WRITTEN.pop()
        _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        forget_tables()
    except Exception:  # the JVM may be gone already
        _WRITTEN.clear()


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of a value of bounded size whose classes travel along, as an executor need not have this package."""
    return sent(spark, cloudpickle.dumps(value))


def sent(spark: SparkSession, value: bytes) -> Callable[[], object]:
    """A broadcast of a pickled value; what loads it holds on to nothing, so many can be loaded in turn."""
    broadcast = spark.sparkContext.broadcast(value)

    def load() -> object:
        value = pickle.loads(broadcast.value)
        broadcast.__dict__.pop("_value", None)
        return value

    return load


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
