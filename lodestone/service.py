"""The public face: compile, search, explain, status, selections; and tools that answer JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.clock import now_ms
from lodestone.operators import usage
from lodestone.operators.postings import Indexed
from lodestone.plans import ranking
from lodestone.plans.compiler import CompiledQuery, compile_detailed, compile_query
from lodestone.plans.dsl import KEY_NAMES
from lodestone.plans.engine import Engine, Provider, Response
from lodestone.plans.query import TYPES, Filter, QueryError, SearchQuery, Sort, filters_from_json, parse_type
from lodestone.settings import Settings
from lodestone.sources import cache
from lodestone.streaming import tail

USAGE = "entity_id string, query string, ts_ms long"
# The tools' names and the types that each searches.
SEARCH_TOOLS = {"search_system": (), "search_files": ("file", "directory"), "search_processes": ("process",),
                "search_apps": ("application",), "search_services": ("service",), "search_windows": ("window",)}
OTHER_TOOLS = ("compile_query", "index_status", "dsl_reference", "record_selection")
TOOL_FIELDS = ("id", "entity_type", "name", "display_name", "path", "subtitle", "score", "metadata")


class SearchService:
    """Answers queries over providers. Selections are lines of JSON in a file; unreadable ones are none."""

    def __init__(self, spark: SparkSession, providers: list[Provider], settings: Settings | None = None, usage_log: str | None = None, now: int | None = None,
                 index_root: str | None = None, scan: Callable[[], DataFrame] | None = None):
        """index_root: the folder of the file index; scan: what reads its files and directories, as entities."""
        self.index_root, self.scan = index_root, scan
        self.spark, self.providers, self.settings = spark, providers, (settings or Settings()).normalised()
        self.usage_log, self._now = Path(usage_log) if usage_log else None, now

    @property
    def now(self) -> int:
        return now_ms() if self._now is None else self._now

    def used(self) -> DataFrame | None:
        """The remembered selections, one row an entity."""
        if not self.usage_log or not self.usage_log.exists():
            return None
        rows = []
        for line in self.usage_log.read_text().splitlines():
            try:
                r = json.loads(line)
                rows.append((str(r["entity_id"]), str(r["query"]), int(r["ts_ms"])))
            except (ValueError, KeyError, TypeError):
                continue
        return usage.usage_of(self.spark.createDataFrame(rows, USAGE)) if rows else None

    def engine(self) -> Engine:
        weights = ranking.Weights() if self.settings.fuzzy_matching else ranking.Weights().without_fuzzy()
        used = self.used() if self.settings.usage_ranking else None
        return Engine(self.providers, now=self.now, ranker=ranking.heuristic(self.now, weights, used))

    def compile(self, line: str) -> CompiledQuery:
        return compile_detailed(line)

    def search(self, line: str, types: tuple[str, ...] | None = None, limit: int | None = None, sort: Sort | None = None, filters: tuple[Filter, ...] = ()) -> Response:
        query = compile_query(line, types, limit, sort, filters)
        own = query.limit if limit is not None or "limit:" in query.to_dsl() else self.settings.result_limit
        return self.engine().respond(line, query, own)

    def search_query(self, query: SearchQuery) -> Response:
        return self.engine().respond(query.to_dsl(), query)

    def explain(self, line: str) -> str:
        return self.engine().explain(compile_query(line))

    def status(self) -> DataFrame:
        """Rows of each provider and type."""
        parts = [
            p.collect(SearchQuery()).groupBy("entity_type").agg(F.count("*").alias("entries")).select(F.lit(p.name).alias("provider"), F.lit(p.scope).alias("scope"), "entity_type", "entries")
            for p in self.providers
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    # The file index: a stored table and its postings, below one folder.

    def rebuild(self) -> int:
        """Reads the files anew into the stored table, builds its postings, and puts both in use; the number of entries."""
        if not self.index_root or not self.scan:
            raise ValueError("this service has no file index")
        rows = self.scan()
        cache.write_version(rows, f"{self.index_root}/files", saved_at=self.now)
        stored = cache.load(self.spark, f"{self.index_root}/files")
        self._use(Indexed.build("files", stored, f"{self.index_root}/postings-{self.now}"))
        return stored.count()

    def update(self, mutations: DataFrame, batch_id: int, table: str) -> bool:
        """Applies a batch of the journal's mutations to the file table at ``table``; False if it was applied before."""
        return tail.apply_version(self.spark, table, mutations, batch_id)

    def refresh(self) -> list[str]:
        """Lets all snapshots be taken anew; the names of their providers."""
        fresh = [p for p in self.providers if hasattr(p, "refresh")]
        for p in fresh:
            p.refresh()
        return [p.name for p in fresh]

    def _use(self, provider: Provider) -> None:
        self.providers = [p for p in self.providers if p.name != provider.name] + [provider]

    def record_selection(self, line: str, entity_id: str) -> None:
        if self.usage_log and entity_id:
            self.usage_log.parent.mkdir(parents=True, exist_ok=True)
            with self.usage_log.open("a") as f:
                f.write(json.dumps({"entity_id": entity_id, "query": line, "ts_ms": self.now}) + "\n")

    def recent_selections(self, n: int = 10) -> list:
        used = self.used()
        return usage.recent(used, n).collect() if used is not None else []

    def reset_usage(self) -> None:
        if self.usage_log:
            self.usage_log.unlink(missing_ok=True)

    # Tools.

    def call(self, tool: str, arguments: dict) -> dict:
        """The answer of a tool as plain data; QueryError if the request cannot be understood."""
        if tool in SEARCH_TOOLS:
            line = arguments.get("query")
            if not isinstance(line, str):
                raise QueryError("invalid-query", "query is a string")
            types = SEARCH_TOOLS[tool]
            if not types:
                types = tuple(t for raw in arguments.get("types", TYPES) if (t := parse_type(str(raw)))) or TYPES
            got = self.search(line, types, arguments.get("limit"), filters=tuple(filters_from_json(arguments.get("filters", {}))))
            rows = [{k: r[k] for k in TOOL_FIELDS} for r in got.results]
            return {"compiled": got.compiled, "total": got.total, "truncated": got.truncated, "warnings": got.warnings, "results": rows}
        if tool == "compile_query":
            got = self.compile(str(arguments.get("query", "")))
            return {"compiled": got.query.to_dsl(), "source": got.source, "notes": list(got.notes)}
        if tool == "index_status":
            return {"providers": [r.asDict() for r in self.status().collect()]}
        if tool == "dsl_reference":
            return {"keys": {k: list(v) for k, v in KEY_NAMES.items()}}
        if tool == "record_selection":
            self.record_selection(str(arguments.get("query", "")), str(arguments.get("entity_id", "")))
            return {"recorded": True}
        raise QueryError("unknown-tool", f"tools are {', '.join((*SEARCH_TOOLS, *OTHER_TOOLS))}")
