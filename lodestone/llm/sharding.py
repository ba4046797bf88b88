"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; row r of n gets the fractional rank
(2r + 1) / 2n. Sorting all rows by fractional rank interleaves the sources in proportion, so any contiguous cut holds
the mixture; the order is cut into shards whose row counts differ by one at most (law ``rows``).

Both rankings are distributed. The hash is of the seed, the id, the text's CRC-32 and size and, for rows alike in all that
is read, their number among these; it is uniform, so its leading digits deal each source, and each id, hot ones too, into
even buckets. A row's rank is its bucket's offset plus its place in the bucket. The second ranking deals by fractional
rank, which is even by construction, and its offsets follow in closed form from the sources' sizes: from each source
come as many numbers as it has rows, or as there are buckets, whichever is less.

Defined results: a null source is a stratum of its own; null, empty and long texts count by their bytes; repeated rows
are placed one by one (they tie, and which of two identical rows comes first does not show); an empty table gives no
rows; columns of the input named as the output's are replaced, others are dropped unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a ranking holds on average, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


def interleaved_shards(
    df: DataFrame,
    shards: int = 16,
    seed: str = "lodestone",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per input row: the id, the columns to keep, size (UTF-8 bytes plus 1), text_crc32, shard and slot."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col),
        *[F.col(k) for k in keep],
        F.col(source_col).cast("string").alias("__source"),
        (F.length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    # Rows that are alike are counted, and told apart by a number, so that they are dealt like others.
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    rows = alike.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    key = F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in (id_col, "text_crc32", "size", "__copy")))
    rows = rows.withColumn("__key", F.md5(key.cast("binary")))
    total = df.count()
    buckets = buckets or max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32))
    rows = rows.withColumn("__bucket", F.floor("__bucket").cast("int"))

    per_bucket = rows.groupBy("__source", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__source")
    offsets = per_bucket.select(
        F.col("__source").alias("__s"),
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(whole).alias("__of"),
    )
    place = Window.partitionBy("__source", "__bucket").orderBy("__key", F.col(id_col), "text_crc32", "size", "__copy")
    ranked = (
        rows.join(offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__rank", F.col("__offset") + F.row_number().over(place) - 1)
        .withColumn("__half", 2 * F.col("__rank") + 1)
        .withColumn("__cell", F.floor(F.expr(f"__half * {buckets} div (2 * __of)")).cast("int"))
        .withColumn("__fraction", F.col("__half") / (2 * F.col("__of")))
    )

    # Of a source of few rows, each row's cell; of others, each cell's rows: those with (2r + 1) * buckets < 2 * n * g, less
    # those of the cell before.
    sizes = per_bucket.groupBy("__source").agg(F.sum("__n").alias("__of"))
    below = "((2 * __of * ({0}) + {1} - 1) div (2 * {1}))"
    between = f"{below.format('__g + 1', buckets)} - {below.format('__g', buckets)}"
    few = F.col("__of") < buckets
    cells = (
        sizes.withColumn("__g", F.explode(F.sequence(F.lit(0).cast("long"), F.least("__of", F.lit(buckets)) - 1)))
        .select(
            F.when(few, F.expr(f"(2 * __g + 1) * {buckets} div (2 * __of)")).otherwise(F.col("__g")).cast("int").alias("__g"),
            F.when(few, F.lit(1).cast("long")).otherwise(F.expr(between)).alias("__n"),
        )
        .groupBy("__g")
        .agg(F.sum("__n").alias("__n"))
        .select("__g", (F.sum("__n").over(Window.orderBy("__g")) - F.col("__n")).alias("__start"))
    )
    order = Window.partitionBy("__cell").orderBy("__fraction", "__source", "__key", F.col(id_col), "text_crc32", "size", "__copy")
    placed = ranked.join(cells, F.col("__cell") == F.col("__g")).withColumn(
        "__at", F.col("__start") + F.row_number().over(order) - 1
    )
    shard = F.expr(f"((__at + 1) * {shards} - 1) div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        id_col,
        *keep,
        "size",
        "text_crc32",
        "shard",
        (F.col("__at") - F.expr(f"shard * cast({total} as bigint) div {shards}")).cast("long").alias("slot"),
    )
