"""The query model: text, types, filters, sort and limit, all conjunctive, and its canonical spelling."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from lodestone.functions.clock import format_date, format_duration, format_size

TYPES = ("file", "directory", "process", "application", "service", "window")
DEFAULT_LIMIT, MOST_RESULTS = 50, 2000

# The spellings of types, sort keys and directions.
TYPE_NAMES = {
    "file": ("file", "files"),
    "directory": ("directory", "dir", "directories", "folder", "folders"),
    "process": ("process", "processes", "proc", "ps"),
    "application": ("application", "app", "apps", "applications", "program", "programs"),
    "service": ("service", "services", "svc"),
    "window": ("window", "windows", "win"),
}
SORT_NAMES = {
    "relevance": ("relevance", "score"),
    "name": ("name", "filename"),
    "path": ("path",),
    "modified": ("modified", "mtime", "date"),
    "created": ("created", "ctime"),
    "size": ("size",),
    "pid": ("pid",),
    "memory": ("memory", "mem"),
}
DIRECTION_NAMES = {"asc": ("asc", "ascending", "up"), "desc": ("desc", "descending", "down")}

_TYPE = {alias: name for name, aliases in TYPE_NAMES.items() for alias in aliases}
_SORT = {alias: name for name, aliases in SORT_NAMES.items() for alias in aliases}
_DIRECTION = {alias: name for name, aliases in DIRECTION_NAMES.items() for alias in aliases}
QUOTED = ("path", "name", "prefix", "user")


class QueryError(ValueError):
    """A request that cannot be understood, with a stable code and a hint."""

    def __init__(self, code: str, hint: str):
        super().__init__(f"{code}: {hint}")
        self.code, self.hint = code, hint


def parse_type(raw: str) -> str | None:
    return _TYPE.get(raw.strip().lower())


@dataclass(frozen=True)
class TimeBound:
    """kind: within or older (value: milliseconds before now), after or before (value: an instant)."""

    kind: str
    value: int

    def to_dsl(self) -> str:
        text = format_duration(self.value) if self.kind in ("within", "older") else format_date(self.value)
        return {"within": "<", "older": ">", "after": ">=", "before": "<="}[self.kind] + text


@dataclass(frozen=True)
class SizeBound:
    op: str
    bytes: int

    def to_dsl(self) -> str:
        return self.op + format_size(self.bytes)


@dataclass(frozen=True)
class Filter:
    """kind: ext, path, drive, name, prefix, modified, created, size, state, pid, user or visible."""

    kind: str
    value: str | int | bool | TimeBound | SizeBound

    def to_dsl(self) -> str:
        value = self.value
        text = value.to_dsl() if isinstance(value, (TimeBound, SizeBound)) else value
        text = str(text).lower() if isinstance(value, bool) else str(text)
        return f'{self.kind}:"{text}"' if self.kind in QUOTED and " " in text else f"{self.kind}:{text}"


@dataclass(frozen=True)
class Sort:
    key: str
    direction: str = "desc"

    def to_dsl(self) -> str:
        return f"{self.key}-{self.direction}"

    @classmethod
    def parse(cls, raw: str) -> Sort | None:
        """key-direction, also with : or _, or a key alone, which is descending."""
        text = raw.strip().lower().replace(":", "-").replace("_", "-")
        name, dash, direction = text.rpartition("-")
        key, way = (_SORT.get(name), _DIRECTION.get(direction)) if dash else (_SORT.get(text), "desc")
        return cls(key, way) if key and way else None


@dataclass(frozen=True)
class SearchQuery:
    text: str | None = None
    types: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: Sort | None = None
    limit: int = field(default=DEFAULT_LIMIT)

    @classmethod
    def plain(cls, text: str) -> SearchQuery:
        return cls(text=text.strip() or None)

    def with_types(self, *types: str) -> SearchQuery:
        return replace(self, types=tuple(types))

    def with_filter(self, kind: str, value) -> SearchQuery:
        return replace(self, filters=(*self.filters, Filter(kind, value)))

    def with_sort(self, key: str, direction: str = "desc") -> SearchQuery:
        return replace(self, sort=Sort(key, direction))

    def with_limit(self, limit: int) -> SearchQuery:
        return replace(self, limit=max(1, min(MOST_RESULTS, limit)))

    @property
    def tokens(self) -> list[str]:
        return (self.text or "").split()

    @property
    def empty(self) -> bool:
        return not self.text and not self.filters

    def to_dsl(self) -> str:
        parts = [f"type:{t}" for t in self.types] + [f.to_dsl() for f in self.filters]
        if self.sort:
            parts.append(f"sort:{self.sort.to_dsl()}")
        if self.text and self.text.strip():
            parts.append(self.text.strip())
        if self.limit != DEFAULT_LIMIT:
            parts.append(f"limit:{self.limit}")
        return " ".join(parts)


def filters_from_json(given: dict) -> list[Filter]:
    """Filters of a JSON request: extension, path, name, drive, state and pid."""
    kinds = {"extension": "ext", "path": "path", "name": "name", "drive": "drive", "state": "state", "pid": "pid"}
    out = []
    for key, value in given.items():
        if key not in kinds:
            raise QueryError("invalid-filter", f"unknown filter {key}")
        if key == "pid":
            if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 1 << 32:
                raise QueryError("invalid-filter", "pid is a whole number of 32 bits")
        elif not isinstance(value, str) or not value.strip():
            raise QueryError("invalid-filter", f"{key} is a string")
        out.append(Filter(kinds[key], value[0] if key == "drive" else value.lstrip(".") if key == "extension" else value))
    return out
