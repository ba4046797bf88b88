"""Text matching as Column expressions; the fuzzy matcher is the one Arrow-batched Python function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what separates tokens, beside white space.
SEPARATORS = "-_/\\.,;:()[]{}'\"+&|=@#"
_SPLIT = r"[\s\-_/\\.,;:()\[\]{}'\"+&|=@#]+"
#: The one letter whose lower case has two characters, and a private character to hold its place.
LONG, HELD = "İ", ""

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FUZZY = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])


def lower_each(x: Column) -> Column:
    """Lower case, character by character, so that positions stay."""
    return F.translate(F.lower(F.translate(x, LONG, HELD)), HELD, LONG)


def tokens_of(x: Column) -> Column:
    return F.filter(F.split(lower_each(x), _SPLIT), lambda t: t != "")


def has_token(x: Column, needle: str) -> Column:
    wanted = needle.strip().lower()
    return F.array_contains(tokens_of(x), wanted) if wanted else F.lit(False)


def contains(lowered: Column, needle: str) -> Column:
    """Whether a lowered column holds the needle; an empty needle is always there."""
    n = needle.strip().lower()
    return lowered.contains(n) if n else F.lit(True)


def starts_with(lowered: Column, needle: str) -> Column:
    n = needle.strip().lower()
    return lowered.startswith(n) if n else F.lit(True)


def lower_one_by_one(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def substring_range(x: Column, needle: str) -> Column:
    """struct(start, end) of the first occurrence, null if there is none."""
    n = lower_one_by_one(needle)
    at = F.locate(n, lower_each(x))
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + len(n)).cast("int").alias("end")))


def substring_score(x: Column, needle: str) -> Column:
    """100, less up to 60 the later the needle begins; null if it is not there."""
    start = substring_range(x, needle)["start"]
    late = F.floor(start * 40 / F.greatest(F.length(x), F.lit(1)))
    return F.when(start.isNotNull(), F.lit(100) - F.least(F.lit(60), late)).cast("int")


def fuzzy_match(needle: str, text: str) -> tuple[int, list[int]] | None:
    """Score (0 to 200) and positions of the leftmost subsequence match, None if there is none."""
    wanted = [c for c in lower_one_by_one(needle) if not c.isspace()]
    if not wanted:
        return 0, []
    low = lower_one_by_one(text)
    at, positions = -1, []
    for c in wanted:
        at = low.find(c, at + 1)
        if at < 0:
            return None
        positions.append(at)
    n = len(positions)
    gaps = np.diff(positions) - 1
    score = 12 * n + int(np.where(gaps == 0, 8, -np.minimum(24, 3 * gaps)).sum())
    for p in positions:
        before = text[p - 1] if p else ""
        if not before:
            score += 12
        elif before.isspace() or before in SEPARATORS:
            score += 10
        elif text[p].isupper() and before.islower():
            score += 6
    span = positions[-1] - positions[0] + 1
    score += 100 * n // span // 4 - min(24, 2 * positions[0]) - min(16, (len(text) - n) // 8)
    return max(0, min(200, score)), positions


def fuzzy(x: Column, needle: str) -> Column:
    """struct(score, positions) of the fuzzy match, null if there is none or the text is null."""

    @F.pandas_udf(FUZZY)
    def matched(texts: pd.Series) -> pd.DataFrame:
        found = [fuzzy_match(needle, t) if t is not None else None for t in texts]
        return pd.DataFrame({"score": [f and f[0] for f in found], "positions": [f and f[1] for f in found]}, dtype=object)

    got = matched(x)
    return F.when(got["score"].isNotNull(), got)


def runs(positions: Column) -> Column:
    """Positions as ranges of neighbours."""
    ones = F.transform(positions, lambda p: F.struct(p.cast("int").alias("start"), (p + 1).cast("int").alias("end")))
    return merged(ones)


def merged(ranges: Column) -> Column:
    """Ranges in order, without empty ones; ranges that touch or overlap are one."""
    real = F.array_sort(F.filter(F.coalesce(ranges, F.array().cast(RANGES)), lambda r: r["end"] > r["start"]))

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))),
        )
        touches = (F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(touches, joined).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(real, F.array().cast(RANGES), add)


def match_ranges(x: Column, needle: str) -> Column:
    """What to highlight: the substring, else the fuzzy match's runs, else nothing."""
    n = needle.strip()
    if not n:
        return F.array().cast(RANGES)
    whole = substring_range(x, n)
    loose = F.coalesce(runs(fuzzy(F.when(whole.isNull(), x), n)["positions"]), F.array().cast(RANGES))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(loose)


def marked(x: Column, ranges: Column, before: str = "[", after: str = "]") -> Column:
    """The text with marks around the ranges, which are in order and cut to the text."""
    size = F.length(x)

    def add(done: Column, r: Column) -> Column:
        start, end = F.least(r["start"], size), F.least(r["end"], size)
        text = F.concat(
            done["text"], x.substr(done["at"] + 1, start - done["at"]), F.lit(before), x.substr(start + 1, end - start), F.lit(after)
        )
        return F.when(end > start, F.struct(text.alias("text"), end.alias("at"))).otherwise(done)

    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(ranges, zero, add, lambda d: F.concat(d["text"], x.substr(d["at"] + 1, size)))


def trigrams(x: Column) -> Column:
    """The distinct runs of three characters."""
    low = F.lower(x)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(places, lambda i: low.substr(i, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def volume_id(x: Column) -> Column:
    """A volume's name without slashes at its end, in lower case."""
    return F.lower(F.regexp_replace(F.trim(x), r"[\\/]+$", ""))
