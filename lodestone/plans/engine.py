"""The search engine: providers, filters, ranking, order and limit, as one DataFrame plan."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions import derive
from lodestone.functions import text as tx
from lodestone.functions.clock import now_ms
from lodestone.plans import ranking
from lodestone.plans.predicates import passes, text_in_files
from lodestone.plans.query import MOST_RESULTS, TYPES, SearchQuery, Sort

RESULT = ("id", "entity_type", "name", "display_name", "path", "subtitle", "score", "matched_field", "match_ranges", "metadata")


class Provider(Protocol):
    """A source of entities; scope is live, cached or hybrid."""

    name: str
    scope: str
    types: tuple[str, ...]

    def collect(self, query: SearchQuery) -> DataFrame: ...


@dataclass
class Table:
    """A provider of rows that are a DataFrame already."""

    name: str
    rows: DataFrame
    types: tuple[str, ...] = TYPES
    scope: str = "cached"

    def collect(self, query: SearchQuery) -> DataFrame:
        return self.rows


@dataclass
class Response:
    """What a front end shows; total counts the rows returned."""

    query: str
    compiled: str
    total: int
    truncated: bool
    results: list
    warnings: list[str] = field(default_factory=list)


def order_by(sort: Sort | None) -> list[Column]:
    """The order of results: the key, then providers' and rows' own order, so that it is total."""
    key = sort.key if sort else "relevance"
    own = F.coalesce(F.when(F.col("entity_type").isin("process", "window"), F.col("pid")), F.lit((1 << 32) - 1))
    column = {
        "relevance": F.col("score"),
        "name": F.lower("display_name"),
        "path": F.coalesce(F.col("lpath"), F.lit("")),
        "modified": F.col("modified"),
        "created": F.when(F.col("entity_type").isin("file", "directory"), F.col("created")),
        "size": F.coalesce(F.when(F.col("entity_type") == "file", F.col("size")), F.lit(0)),
        "memory": F.coalesce(F.when(F.col("entity_type") == "process", F.col("memory_bytes")), F.lit(0)),
        "pid": own,
    }[key]
    first = column.asc_nulls_first() if sort and sort.direction == "asc" else column.desc_nulls_last()
    return [first, F.col("provider_ord").asc(), F.col("collect_ord").asc(), F.col("id").asc()]


class Engine:
    def __init__(self, providers: Iterable[Provider], now: int | None = None, ranker: ranking.Ranker | None = None):
        self.providers = list(providers)
        self.now = now_ms() if now is None else now
        self.ranker = ranker or ranking.heuristic(self.now)
        self.warnings: list[str] = []

    def candidates(self, query: SearchQuery, ext_any: bool = False) -> DataFrame:
        """Rows of the providers asked that pass all filters. A provider that fails is a warning."""
        self.warnings, parts = [], []
        for p in self.providers:
            if query.types and not set(query.types) & set(p.types):
                continue
            try:
                parts.append(p.collect(query))
            except Exception as e:
                self.warnings.append(f"{p.name}: {e}")
        if not parts:
            raise ValueError("no provider answered: " + "; ".join(self.warnings))
        where = passes(query, self.now, ext_any)
        if query.tokens:
            where.append(text_in_files(query.tokens))
        return reduce(DataFrame.where, where, model.union(parts))

    def scored(self, query: SearchQuery, ext_any: bool = False) -> DataFrame:
        return self.ranker(query, self.candidates(query, ext_any))

    def search(self, query: SearchQuery, limit: int | None = None, ext_any: bool = False) -> DataFrame:
        """The first rows of the order, with rank from 1; one more than the limit tells whether there are others."""
        n = max(1, min(MOST_RESULTS, limit if limit is not None else query.limit))
        return self.scored(query, ext_any).orderBy(*order_by(query.sort)).limit(n)

    def results(self, query: SearchQuery, limit: int | None = None) -> DataFrame:
        """search() with the columns of a result; ranges that the ranker gave none of come from the whole text."""
        rows = self.search(query, limit)
        found = F.col("match_ranges")
        if query.text:
            found = F.when(F.size(found) > 0, found).otherwise(tx.match_ranges(F.col("name"), query.text))
        return rows.withColumns({"match_ranges": found, "subtitle": derive.subtitle(), "metadata": derive.metadata()}).select(*RESULT)

    def respond(self, raw: str, query: SearchQuery, limit: int | None = None) -> Response:
        n = max(1, min(MOST_RESULTS, limit if limit is not None else query.limit))
        rows = self.scored(query).orderBy(*order_by(query.sort)).limit(n + 1)
        rows = rows.withColumns({"subtitle": derive.subtitle(), "metadata": derive.metadata()}).select(*RESULT).collect()
        # Without results and without text there is nothing to warn about.
        warnings = self.warnings if rows or query.text else []
        return Response(raw, query.to_dsl(), min(len(rows), n), len(rows) > n, rows[:n], warnings)

    def explain(self, query: SearchQuery) -> str:
        """How each provider found its candidates, where it can tell, and Spark's plan."""
        found = self.search(query)
        plan = found._jdf.queryExecution().explainString(
            found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        own = [p.explain() for p in self.providers if hasattr(p, "explain")]
        return "\n".join([*own, plan])

    def timings(self, query: SearchQuery) -> list[tuple[str, int, float]]:
        """(provider, rows that pass, milliseconds) of each provider asked, each by itself."""
        out = []
        for p in self.providers:
            if query.types and not set(query.types) & set(p.types):
                continue
            began = time.perf_counter()
            rows = Engine([p], self.now, self.ranker).candidates(query).count()
            out.append((p.name, rows, (time.perf_counter() - began) * 1000))
        return out


def types_present(results: DataFrame) -> DataFrame:
    """results(rank, entity_type) -> position, entity_type: the types in the order in which they first come."""
    first = results.groupBy("entity_type").agg(F.min("rank").alias("first"))
    # A row a type: six at most.
    return first.select(F.row_number().over(Window.orderBy("first")).alias("position"), "entity_type")
