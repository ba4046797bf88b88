"""Relevance as Column expressions; a ranker is a function from a query and a DataFrame to a scored DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.query import SearchQuery

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
HALF_LIFE_DAYS, HORIZON_HOURS = 30, 24 * 365


@dataclass(frozen=True)
class Weights:
    """The points of each signal."""

    exact: float = 100.0
    prefix: float = 60.0
    substring: float = 40.0
    token: float = 30.0
    fuzzy: float = 10.0
    usage: float = 8.0
    recency: float = 5.0
    path_factor: float = 0.5
    untitled: float = -25.0
    minimum: float = 1.0
    preference: dict[str, float] = field(
        default_factory=lambda: {"file": 4.0, "directory": 3.0, "process": 5.0, "application": 8.0, "service": 2.0, "window": 2.0}
    )

    def scaled(self, factor: float) -> Weights:
        """All points but the path's factor and the minimum, times a factor."""
        points = ("exact", "prefix", "substring", "token", "fuzzy", "usage", "recency")
        return replace(
            self,
            **{p: getattr(self, p) * factor for p in points},
            preference={k: v * factor for k, v in self.preference.items()},
        )

    def without_fuzzy(self) -> Weights:
        """Takes the base points of fuzzy matches away; such matches stay."""
        return replace(self, fuzzy=0.0)


Ranker = Callable[[SearchQuery, DataFrame], DataFrame]


def field_points(needle: str, column: str, lowered: str, weights: Weights, allow_fuzzy: bool) -> tuple[Column, Column]:
    """Points of one word in one column, and the ranges it matched; null points where it is not there."""
    x, low = F.col(column), F.col(lowered)
    n = needle.lower()
    size = F.length(x)
    at = tx.substring_range(x, needle)
    exact, prefix = low == n, low.startswith(n)
    late = at["start"] / F.greatest(size, F.lit(1)) * weights.substring * 0.25
    points = (
        F.when(exact, weights.exact)
        .when(prefix, weights.prefix)
        .when(at.isNotNull(), F.greatest(F.lit(1.0), F.lit(weights.substring) - late))
    )
    whole = F.struct(F.lit(0).alias("start"), size.cast("int").alias("end"))
    head = F.struct(F.lit(0).alias("start"), F.lit(len(needle)).alias("end"))
    ranges = F.when(exact, F.array(whole)).when(prefix, F.array(head)).when(at.isNotNull(), F.array(at))
    if allow_fuzzy and len(needle) >= 2:
        # Only rows that nothing else matched go through Python.
        loose = tx.fuzzy(F.when(points.isNull() & (size >= len(needle)), x), needle)
        points = F.coalesce(points, F.lit(weights.fuzzy) + loose["score"] / 20.0)
        ranges = F.coalesce(ranges, tx.runs(loose["positions"]))
    bonus = F.when(~exact & tx.has_token(x, needle), weights.token).otherwise(0.0)
    return F.when(x != "", points + bonus), ranges


def recency(modified: Column, now: int) -> Column:
    """1 in the first hour, then falling with the logarithm of the age to 0 after a year; 0 if unknown."""
    hours = F.greatest(F.lit(now) - modified, F.lit(0)) / float(HOUR_MS)
    fall = F.lit(1.0) - F.log(F.lit(1.0) + hours) / math.log(1.0 + HORIZON_HOURS)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fall))
    return F.when(modified.isNull(), 0.0).when(hours <= 1, 1.0).otherwise(bounded)


def usage_boost(count: Column, most: Column, last: Column, now: int) -> Column:
    """How often against the most, by logarithms, halved every 30 days."""
    often = F.log(F.lit(1.0) + count) / F.log(F.lit(1.0) + F.greatest(most, F.lit(1)))
    days = F.greatest(F.lit(now) - last, F.lit(0)) / float(DAY_MS)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), often)) * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), F.lit(0.0))


def heuristic(now: int, weights: Weights | None = None, usage: DataFrame | None = None) -> Ranker:
    """The default ranker: words in names and paths, use, recency and type. Rows that miss a word are dropped.

    usage has entity_id, selection_count and last_selected_ms, one row an entity.
    """
    w = weights or Weights()

    def rank(query: SearchQuery, df: DataFrame) -> DataFrame:
        none = F.array().cast(tx.RANGES)
        name_points, path_points, name_ranges, path_ranges = F.lit(0.0), F.lit(0.0), [none], [none]
        # Files with a single word have passed a filter for it, so no loose match is left to find, and no Python to run.
        settled = len(query.tokens) == 1 and bool(query.types) and set(query.types) <= {"file", "directory"}
        for i, token in enumerate(query.tokens):
            p, r = field_points(token, "name", "lname", w, allow_fuzzy=not settled)
            q, s = field_points(token, "path", "lpath", w, allow_fuzzy=False)
            df = df.withColumns({f"__n{i}": F.struct(p.alias("p"), r.alias("r")), f"__p{i}": F.struct(q.alias("p"), s.alias("r"))})
            df = df.where(F.col(f"__n{i}.p").isNotNull() | F.col(f"__p{i}.p").isNotNull())
            in_name = F.col(f"__n{i}.p").isNotNull()
            name_points = name_points + F.coalesce(F.col(f"__n{i}.p"), F.lit(0.0))
            path_points = path_points + F.when(in_name, 0.0).otherwise(F.col(f"__p{i}.p") * w.path_factor)
            name_ranges.append(F.coalesce(F.col(f"__n{i}.r"), none))
            path_ranges.append(F.when(in_name, none).otherwise(F.coalesce(F.col(f"__p{i}.r"), none)))
        boost = F.lit(0.0)
        if usage is not None:
            # Bounded by the usage store's capacity; Spark broadcasts it by its size.
            most = usage.agg(F.max("selection_count")).first()[0] or 1
            used = usage.select(F.col("entity_id").alias("id"), F.col("selection_count").alias("__c"), F.col("last_selected_ms").alias("__l"))
            df = df.join(used, "id", "left")
            boost = usage_boost(F.col("__c"), F.lit(most), F.col("__l"), now)
        preference = reduce(
            lambda out, k: F.when(F.col("entity_type") == k[0], k[1]).otherwise(out), w.preference.items(), F.lit(0.0)
        )
        untitled = F.when((F.col("entity_type") == "window") & (F.trim("name") == ""), w.untitled).otherwise(0.0)
        parts = {"name": name_points, "path": path_points, "usage_frequency": boost * w.usage,
                 "recency": recency(F.col("modified"), now) * w.recency, "entity_preference": preference,
                 "untitled_window": untitled}
        df = df.withColumn("__parts", F.struct(*(v.cast("double").alias(k) for k, v in parts.items())))
        total = reduce(lambda a, k: a + F.col(f"__parts.{k}"), parts, F.lit(0.0))
        listed = F.filter(
            F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"__parts.{k}").alias("value")) for k in parts)), lambda c: c["value"] != 0
        )
        matched = F.when(F.col("__parts.name") > 0, "name").when(F.col("__parts.path") > 0, "path").otherwise("none")
        ranges = F.when(F.col("__parts.name") > 0, tx.merged(F.concat(*name_ranges))).otherwise(tx.merged(F.concat(*path_ranges)))
        return (
            df.withColumns({"score": total, "components": listed, "matched_field": matched, "match_ranges": ranges})
            .where(F.col("score") >= w.minimum)
            .drop("__parts", "__c", "__l", *(f"__{x}{i}" for x in "np" for i in range(len(query.tokens))))
        )

    return rank


def _flat(score: Column) -> Ranker:
    def rank(query: SearchQuery, df: DataFrame) -> DataFrame:
        nothing = {"components": F.array().cast("array<struct<name:string,value:double>>"), "matched_field": F.lit("none"),
                   "match_ranges": F.array().cast(tx.RANGES)}
        return df.withColumns({"score": score.cast("double"), **nothing})

    return rank


def noop() -> Ranker:
    """Keeps all rows with score 0."""
    return _flat(F.lit(0.0))


def keep_all(now: int) -> Ranker:
    """Keeps all rows, newer ones first: 30 less the age in hours, at most 30 of them."""
    hours = F.greatest(F.lit(now) - F.col("modified"), F.lit(0)) / float(HOUR_MS)
    return _flat(F.coalesce(F.lit(30.0) - F.least(F.lit(30.0), hours), F.lit(0.0)))


def explained(components: Column) -> Column:
    """name +60.0, recency +3.2"""
    return F.array_join(F.transform(components, lambda c: F.format_string("%s %+.1f", c["name"], c["value"])), ", ")
