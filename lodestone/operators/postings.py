"""Inverted indexes over the file table, and the planner that proposes candidates from them.

Indexes only ever propose a superset; the filters decide, so results are the same with and without. Postings are rows
(key, record_id), sorted by key within Parquet files, so that a lookup reads the row groups of its keys alone. Grams
that more than ``frequent`` records have are not kept: a query skips them.

Changes of the table go into the indexes as they come (``updated``), and once enough of them have, the indexes are to be
built anew (``needs_compaction``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.query import SearchQuery

# The planner's limits, and the floor and share of a gram that is too frequent.
BUDGET, RATIO, FLOOR, SHARE, PREFIX = 250_000, 8, 512, 50, 24
# The share of changed records, and its bounds, from which indexes are built anew.
DRIFT, LEAST_DRIFT, MOST_DRIFT = 20, 1_000, 20_000


@dataclass
class Plan:
    kind: str
    sources: list[tuple[str, str, int]] = field(default_factory=list)
    initial: int = 0
    note: str = ""

    def describe(self) -> str:
        """extension 'pdf' 4791, trigram 'cedar-123' 554"""
        return ", ".join(f"{kind} '{word}' {n}" for kind, word, n in self.sources) or "no source"


def needs_compaction(records: int, changed: int) -> bool:
    """Whether so many changes of a table of so many records call for new indexes."""
    return records > 0 and changed >= max(LEAST_DRIFT, min(MOST_DRIFT, records // DRIFT))


@dataclass
class Postings:
    extension: DataFrame
    prefix: DataFrame
    trigram: DataFrame
    gram_stats: DataFrame

    @staticmethod
    def _keys(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        extension = files.where("extension <> ''").select(F.lower("extension").alias("key"), "record_id")
        prefix = files.select(F.substring("lname", 1, PREFIX).alias("key"), "record_id")
        return extension, prefix, files.select(F.explode(tx.trigrams(F.col("lpath"))).alias("key"), "record_id")

    @classmethod
    def build(cls, files: DataFrame) -> Postings:
        """files: record_id, lname, lpath, extension."""
        total = files.count()
        extension, prefix, grams = cls._keys(files)
        most = max(FLOOR, total // SHARE)
        stats = grams.groupBy("key").agg(F.count("*").alias("df")).withColumn("dropped", F.col("df") > most)
        kept = grams.join(stats.where("NOT dropped").select("key"), "key", "left_semi")
        return cls(extension, prefix, kept, stats)

    def without(self, records: DataFrame) -> Postings:
        """The indexes less the records (record_id) that are gone. The counts of grams stay, as upper bounds."""
        gone = records.select("record_id").distinct()
        return Postings(*(df.join(gone, "record_id", "left_anti") for df in (self.extension, self.prefix, self.trigram)), self.gram_stats)

    def updated(self, changed: DataFrame) -> Postings:
        """The indexes with the records of changed (as in build) as they are now: new ones, and others in place of the old.

        A gram that was dropped stays dropped; a new one is kept until the indexes are built anew.
        """
        rest = self.without(changed)
        extension, prefix, grams = self._keys(changed)
        known = self.gram_stats.select("key", "dropped")
        more = grams.groupBy("key").agg(F.count("*").alias("df")).join(known, "key", "left")
        more = more.select("key", "df", F.coalesce("dropped", F.lit(False)).alias("dropped"))
        stats = self.gram_stats.unionByName(more).groupBy("key").agg(F.sum("df").alias("df"), F.bool_or("dropped").alias("dropped"))
        kept = grams.join(stats.where("dropped").select("key"), "key", "left_anti")
        both = [a.select("key", "record_id").union(b.select("key", "record_id")) for a, b in ((rest.extension, extension), (rest.prefix, prefix), (rest.trigram, kept))]
        return Postings(*both, stats)

    def lookup_any(self, extensions: list[str]) -> DataFrame:
        """The records that have one of the extensions."""
        keys = [e.strip().lstrip(".").lower() for e in extensions]
        return self.extension.where(F.col("key").isin(keys)).select("record_id").distinct()

    def save(self, path: str) -> None:
        for name in ("extension", "prefix", "trigram", "gram_stats"):
            df = getattr(self, name)
            # Dealt by the key's hash, as ranges would need a second reading; each file is in the key's order.
            df.repartition("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Postings:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("extension", "prefix", "trigram", "gram_stats")))

    def statistics(self) -> DataFrame:
        """extensions and prefixes (different ones), grams kept and dropped, postings of grams, and bytes: eight for each
        record in each index, and the keys of grams."""
        grams = self.gram_stats.agg(
            F.count_if(~F.col("dropped")).alias("grams"),
            F.count_if("dropped").alias("dropped_grams"),
            F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("df"))), F.lit(0)).alias("postings"),
            F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("__keys"),
        )
        extensions = self.extension.agg(F.countDistinct("key").alias("extensions"), F.count("*").alias("__e"))
        prefixes = self.prefix.agg(F.countDistinct("key").alias("prefixes"), F.count("*").alias("__p"))
        # A row each.
        whole = extensions.join(prefixes, F.lit(True)).join(grams, F.lit(True))
        size = 8 * (F.col("__e") + F.col("__p") + F.col("postings")) + F.col("__keys")
        return whole.withColumn("bytes", size).drop("__e", "__p", "__keys")

    def _lookups(self, query: SearchQuery) -> list[tuple[str, str, DataFrame, int]]:
        """What the indexes know about a query: kind, word, the records, and how many at most."""
        out = []
        words = [str(f.value) for f in query.filters if f.kind in ("path", "name")] + query.tokens
        extensions = [v for f in query.filters if f.kind == "ext" and (v := str(f.value).strip().lower()).lstrip(".")]
        if extensions:
            # All of them, or any: either way what has one of them is enough.
            out.append(("extension", ",".join(extensions), self.lookup_any(extensions)))
        for f in query.filters:
            value = str(f.value).strip().lower()
            if f.kind == "prefix" and value:
                out.append(("prefix", value, self.prefix.where(F.col("key").startswith(value[:PREFIX]))))
        found = [(kind, word, df.select("record_id"), df.count()) for kind, word, df in out]
        for word in words:
            low = word.strip().lower()
            grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
            if not grams:
                continue
            stats = {r["key"]: r for r in self.gram_stats.where(F.col("key").isin(grams)).collect()}
            if any(g not in stats for g in grams):
                # A gram that no record has settles it.
                found.append(("trigram", word, self.trigram.where(F.lit(False)).select("record_id"), 0))
                continue
            kept = [g for g in grams if not stats[g]["dropped"]]
            if kept:
                hits = self.trigram.where(F.col("key").isin(kept)).groupBy("record_id").agg(F.count_distinct("key").alias("n"))
                hits = hits.where(F.col("n") == len(kept)).select("record_id")
                found.append(("trigram", word, hits, min(stats[g]["df"] for g in kept)))
        return sorted(found, key=lambda s: s[3])

    def candidates(self, query: SearchQuery) -> tuple[DataFrame | None, Plan]:
        """Records that can match (None: all) and how they were found: the cheapest source, cut with near ones."""
        found = self._lookups(query)
        plan = Plan("linear", [(kind, word, n) for kind, word, _, n in found])
        if not found or found[0][3] > BUDGET:
            plan.note = "no selective source" if found else "no source"
            return None, plan
        kind, _, records, now = found[0]
        plan.kind, plan.initial = kind, now
        for other, _, more, n in found[1:]:
            if n <= RATIO * max(now, 1):
                # The smaller list first: what stays is a part of it.
                records = records.join(more, "record_id", "left_semi")
                if kind != "trigram" or other != "trigram":
                    plan.kind = "intersection"
        return records, plan


def narrowed(files: DataFrame, postings: Postings, query: SearchQuery, key: str = "record_id") -> tuple[DataFrame, Plan]:
    """The files that the indexes propose. The candidates number at most the planner's budget."""
    records, plan = postings.candidates(query)
    if records is None:
        return files, plan
    return files.join(records.distinct().withColumnRenamed("record_id", key), key, "left_semi"), plan


@dataclass
class Indexed:
    """A provider of files and directories whose candidates come from indexes, where these are selective.

    rows are entities; key names the column that the indexes know as record_id. ready is false while indexes are built:
    the rows are read as they are then.
    """

    name: str
    rows: DataFrame
    postings: Postings | None
    key: str = "file_id"
    types: tuple[str, ...] = ("file", "directory")
    scope: str = "cached"
    last: Plan = field(default_factory=lambda: Plan("linear"))

    @classmethod
    def build(cls, name: str, rows: DataFrame, path: str, key: str = "file_id") -> Indexed:
        """Builds the indexes, writes them to path and reads them back."""
        Postings.build(rows.withColumnRenamed(key, "record_id")).save(path)
        return cls(name, rows, Postings.load(rows.sparkSession, path), key)

    @property
    def ready(self) -> bool:
        return self.postings is not None

    def collect(self, query: SearchQuery) -> DataFrame:
        if not self.ready:
            self.last = Plan("linear", note="indexes are not ready")
            return self.rows
        narrow, self.last = narrowed(self.rows, self.postings, query, self.key)
        return narrow

    def explain(self) -> str:
        note = f" ({self.last.note})" if self.last.note else ""
        return f"{self.name}: {self.last.kind}{note}; {self.last.describe()}"
