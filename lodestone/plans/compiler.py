"""From an input line to a query: the query language if it has any structure, else a phrase, else plain words."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from lodestone.plans.dsl import parse
from lodestone.plans.language import compile_phrase
from lodestone.plans.query import MOST_RESULTS, Filter, SearchQuery, Sort


class QueryCompiler(Protocol):
    """Turns a line into a query and says how; the engine takes any."""

    def compile_detailed(self, line: str) -> CompiledQuery: ...


@dataclass(frozen=True)
class CompiledQuery:
    raw: str
    query: SearchQuery
    source: str
    notes: tuple[str, ...]


def compile_detailed(line: str) -> CompiledQuery:
    raw = line.strip()
    parsed = parse(raw)
    if parsed.structured:
        ignored = (f"ignored unknown keys: {', '.join(parsed.unknown_keys)}",) if parsed.unknown_keys else ()
        return CompiledQuery(raw, parsed.query, "dsl", (*ignored, "source: dsl"))
    phrase = compile_phrase(raw)
    if phrase.matched:
        return CompiledQuery(raw, phrase.query, "natural-language", (*phrase.notes, "source: natural-language"))
    return CompiledQuery(raw, SearchQuery.plain(raw), "plain-text", ("source: plain-text",))


class RuleCompiler:
    """The compiler of this package: rules only."""

    def compile_detailed(self, line: str) -> CompiledQuery:
        return compile_detailed(line)


def compile_query(
    line: str,
    types: tuple[str, ...] | None = None,
    limit: int | None = None,
    sort: Sort | None = None,
    filters: tuple[Filter, ...] = (),
    compiler: QueryCompiler | None = None,
) -> SearchQuery:
    """A compiled line with a front end's overrides: types and sort replace, filters add; option > line > default limit."""
    query = (compiler or RuleCompiler()).compile_detailed(line).query
    query = replace(query, types=types or query.types, filters=query.filters + filters, sort=sort or query.sort)
    return replace(query, limit=max(1, min(MOST_RESULTS, limit))) if limit is not None else query
