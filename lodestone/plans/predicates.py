"""Filters as Column predicates. A filter that a type does not have is false for it, never null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import derive
from lodestone.functions.text import contains, starts_with
from lodestone.plans.query import Filter, SearchQuery, SizeBound, TimeBound

# The words for the states of processes and windows.
PROCESS_STATES, SHOWN, HIDDEN = ("running", "active", "any"), ("visible", "shown"), ("hidden",)


def is_type(*kinds: str) -> Column:
    return F.col("entity_type").isin(*kinds)


def time_bound(at: Column, bound: TimeBound, now: int) -> Column:
    if bound.kind == "within":
        return at >= now - bound.value
    if bound.kind == "older":
        return at < now - bound.value
    return at >= bound.value if bound.kind == "after" else at <= bound.value


def size_bound(n: Column, bound: SizeBound) -> Column:
    return {">": n > bound.bytes, ">=": n >= bound.bytes, "<": n < bound.bytes, "<=": n <= bound.bytes, "=": n == bound.bytes}[bound.op]


def state(word: str) -> Column:
    w = word.strip().lower()
    if not w:
        return F.lit(True)
    service = F.col("svc_state").contains(w) | F.col("svc_start_type").contains(w)
    window = F.col("visible") if w in SHOWN else ~F.col("visible") if w in HIDDEN else F.lit(False)
    return (
        (is_type("service") & service)
        | (is_type("process") & F.lit(w in PROCESS_STATES))
        | (is_type("window") & window)
    )


def predicate(f: Filter, now: int) -> Column:
    value = f.value
    if f.kind == "ext":
        n = value.strip().lstrip(".").lower()
        out = F.lower("extension") == n if n else F.lit(True)
    elif f.kind == "drive":
        letter = value.upper()
        out = (is_type("file", "directory") & (F.upper("drive") == letter)) | (derive.drive_of(F.col("path")) == letter)
    elif f.kind == "path":
        out = F.col("path").isNotNull() & contains(F.col("lpath"), value)
    elif f.kind == "name":
        out = contains(F.col("lname"), value)
    elif f.kind == "prefix":
        out = starts_with(F.col("lname"), value)
    elif f.kind == "modified":
        out = is_type("file", "directory", "process") & time_bound(F.col("modified"), value, now)
    elif f.kind == "created":
        out = is_type("file", "directory") & time_bound(F.col("created"), value, now)
    elif f.kind == "size":
        out = is_type("file") & size_bound(F.col("size"), value)
    elif f.kind == "state":
        out = state(value)
    elif f.kind == "pid":
        out = is_type("process", "window") & (F.col("pid") == value)
    elif f.kind == "user":
        out = is_type("process") & F.col("username").isNotNull() & contains(F.lower("username"), value)
    else:
        out = is_type("window") & (F.col("visible") == F.lit(value))
    return F.coalesce(out, F.lit(False))


def passes(query: SearchQuery, now: int, ext_any: bool = False) -> list[Column]:
    """The type restriction and every filter; with ext_any, extensions are alternatives."""
    out = [is_type(*query.types)] if query.types else []
    found = [f for f in query.filters if f.kind == "ext"] if ext_any else []
    if found:
        out.append(reduce(lambda a, b: a | b, (predicate(f, now) for f in found)))
    return out + [predicate(f, now) for f in query.filters if f not in found]


def text_in_files(tokens: list[str]) -> Column:
    """Files take part if their name holds all words, or one of them and their path all. Others always do."""
    low = [t.lower() for t in tokens]
    in_name = [F.col("lname").contains(t) for t in low]
    in_path = [F.coalesce(F.col("lpath").contains(t), F.lit(False)) for t in low]
    found = reduce(and_, in_name) | (reduce(lambda a, b: a | b, in_name) & reduce(and_, in_path))
    return ~is_type("file", "directory") | found
