"""The query language: words and key:value tokens. Parsing never fails; what is not understood is text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from lodestone.functions.clock import parse_date, parse_duration, parse_size
from lodestone.plans.query import MOST_RESULTS, Filter, SearchQuery, SizeBound, Sort, TimeBound, parse_type

_OPERATOR = re.compile(r"(>=|<=|==|>|<|=)?(.*)", re.DOTALL)
_TOKEN = re.compile(r'(?:[^\s"]|"[^"]*(?:"|\Z))+')

# The spellings of keys.
KEY_NAMES = {
    "type": ("type", "types", "kind"),
    "ext": ("ext", "extension", "filetype"),
    "path": ("path", "in"),
    "name": ("name",),
    "prefix": ("prefix", "starts", "startswith"),
    "drive": ("drive", "volume"),
    "modified": ("modified", "mtime"),
    "created": ("created", "ctime"),
    "size": ("size",),
    "state": ("state", "status"),
    "pid": ("pid",),
    "user": ("user", "owner"),
    "visible": ("visible", "visibility"),
    "sort": ("sort", "order"),
    "limit": ("limit", "top"),
    "mode": ("exact", "fuzzy"),
}
VISIBLE_NAMES = {"true": True, "yes": True, "1": True, "shown": True, "false": False, "no": False, "0": False, "hidden": False}
_KEY = {alias: key for key, aliases in KEY_NAMES.items() for alias in aliases}


@dataclass(frozen=True)
class Parsed:
    query: SearchQuery
    structured: bool
    unknown_keys: tuple[str, ...]
    free_text: str


def split_tokens(line: str) -> list[str]:
    """Words by white space; double quotes hold words together and stay."""
    return _TOKEN.findall(line)


def unquote(value: str) -> str:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return value[1:-1]
    return value.replace('"', "")


def parse_time_bound(value: str) -> TimeBound | None:
    """< and > take a duration first and then a date, <= and >= the other way round, = a date only."""
    op, rest = _OPERATOR.fullmatch(value.strip()).groups()
    duration, date = parse_duration(rest), parse_date(rest)
    span, instant = {"<": ("within", "before"), "<=": ("within", "before"), ">": ("older", "after"), ">=": ("older", "after")}.get(
        op, ("within", "after")
    )
    by_span = TimeBound(span, duration) if duration is not None and op not in ("=", "==") else None
    by_date = TimeBound(instant, date) if date is not None else None
    return (by_date or by_span) if op in ("<=", ">=") else (by_span or by_date)


def parse_size_bound(value: str) -> SizeBound | None:
    """A size and how to compare with it; at least, if nothing says how."""
    op, rest = _OPERATOR.fullmatch(value.strip()).groups()
    n = parse_size(rest)
    return None if n is None else SizeBound({None: ">=", "==": "="}.get(op, op), n)


def _whole(value: str, bits: int) -> int | None:
    return int(value) if re.fullmatch(r"\+?[0-9]+", value) and int(value) < 1 << bits else None


def _types(query: SearchQuery, value: str) -> SearchQuery | None:
    found = [t for part in re.split(r"[,|]", value) if (t := parse_type(part))]
    return replace(query, types=tuple(dict.fromkeys([*query.types, *found]))) if found else None


def _extensions(query: SearchQuery, value: str) -> SearchQuery | None:
    found = [part.strip().lstrip(".") for part in re.split(r"[,|]", value) if part.strip()]
    for ext in found:
        query = query.with_filter("ext", ext)
    return query if found else None


def _filter(kind: str, read: Callable) -> Callable[[SearchQuery, str], SearchQuery | None]:
    def handle(query: SearchQuery, value: str) -> SearchQuery | None:
        got = read(value)
        return None if got is None else query.with_filter(kind, got)

    return handle


def _sort(query: SearchQuery, value: str) -> SearchQuery | None:
    sort = Sort.parse(value)
    return replace(query, sort=sort) if sort else None


def _limit(query: SearchQuery, value: str) -> SearchQuery | None:
    n = _whole(value, 64)
    return None if n is None else replace(query, limit=max(1, min(MOST_RESULTS, n)))


HANDLERS: dict[str, Callable[[SearchQuery, str], SearchQuery | None]] = {
    "type": _types,
    "ext": _extensions,
    "path": _filter("path", str),
    "name": _filter("name", str),
    "prefix": _filter("prefix", str),
    "drive": _filter("drive", lambda v: v[0]),
    "modified": _filter("modified", parse_time_bound),
    "created": _filter("created", parse_time_bound),
    "size": _filter("size", parse_size_bound),
    "state": _filter("state", str),
    "pid": _filter("pid", lambda v: _whole(v, 32)),
    "user": _filter("user", str),
    "visible": _filter("visible", lambda v: VISIBLE_NAMES.get(v.lower())),
    "sort": _sort,
    "limit": _limit,
    "mode": lambda query, value: query,
}


def parse(line: str) -> Parsed:
    query, structured, words, unknown = SearchQuery(), False, [], []
    for token in split_tokens(line):
        key, colon, value = token.partition(":")
        key, value = key.strip().lower(), unquote(value)
        handler = HANDLERS.get(_KEY.get(key, "")) if colon and value else None
        after = handler(query, value) if handler else None
        if after is not None:
            query, structured = after, True
            continue
        if colon and value and re.fullmatch(r"[a-z_]+", key):
            unknown.append(token)
        words.append(unquote(token))
    text = " ".join(words)
    return Parsed(replace(query, text=text.strip() or None), structured, tuple(unknown), text)
