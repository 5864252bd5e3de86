"""Scalar expressions: cleaning, protected arithmetic, scoring rules, flags and times. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def available(c: str | Column) -> Column:
    """True unless null or blank."""
    return F.length(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))) > 0


def all_available(*cols: str | Column) -> Column:
    return reduce(lambda a, b: a & b, (available(c) for c in cols))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it's null)."""
    return F.when(condition, 1).otherwise(0)


def replace_codes(c: str | Column, aliases: Mapping[str, str]) -> Column:
    """Each code replaced by its alias, others kept."""
    out = col(c)
    return reduce(lambda acc, kv: F.when(out == kv[0], kv[1]).otherwise(acc), aliases.items(), out)


def number(c: str | Column, kind: str = "double", missing: float | None = None, strict: bool = False) -> Column:
    """Lenient number: what isn't one becomes null, or `missing`. A strict one raises on known text that isn't a number."""
    value = col(c).try_cast(kind)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a number: "), col(c).cast("string"))).cast(kind)
        value = F.when(col(c).isNull() | value.isNotNull(), value).otherwise(bad)
    return value if missing is None else F.coalesce(value, F.lit(missing).cast(kind))


def strict_boolean(c: str | Column) -> Column:
    """Only the words true and false in any case, trimmed; all else is null and can be counted as a violation."""
    word = F.lower(F.trim(col(c)))
    return F.when(word == "true", True).when(word == "false", False)


def any_contains(text: str, *cols: str | Column) -> Column:
    """Case-insensitive literal search over several columns."""
    needle = F.lower(F.lit(text))
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(col(c)), needle), F.lit(False)) for c in cols))


def split_label(c: str | Column, splits: Mapping[str, Sequence[int]], strict: bool = False) -> Column:
    """Label of the split that lists the value. A value in none gives null, which checks can count, or raises if strict."""
    value = col(c)
    chain = F
    for label, members in splits.items():
        chain = chain.when(value.isin(*members), label)
    if strict:
        chain = chain.otherwise(F.raise_error(F.concat(F.lit("in no split: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string"))
    return chain


def by_category(c: str | Column, parts: Mapping[str, Sequence[str]]) -> Column:
    """Sum of the columns that count for the row's category (missing ones as 0); 0 for categories not listed."""
    chain, value = F, col(c)
    for name, columns in parts.items():
        chain = chain.when(value == name, reduce(add, (F.coalesce(F.col(x), F.lit(0)) for x in columns)))
    return chain.otherwise(F.lit(0))


def in_order(c: str | Column, order: Sequence[str]) -> Column:
    """Sort key of a custom order: listed values first, as listed, all others after them."""
    place = category_order(c, order)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def status_ladder(steps: Mapping[str, Column], last: str) -> Column:
    """The first status whose condition holds; a null condition doesn't."""
    chain = F
    for name, test in steps.items():
        chain = chain.when(test, name)
    return chain.otherwise(last)


def profile_scores(profiles: Mapping[str, Mapping[str, float]], bands: Mapping[str, tuple[str, Sequence[tuple[float | None, float]]]] | None = None) -> dict[str, Column]:
    """A score for each profile side by side: its linear rules, plus its band table (column, bands) if it has one."""
    out = {}
    for name, rules in profiles.items():
        score = linear_score(rules)
        if bands and name in bands:
            score = score + F.coalesce(band_score(*bands[name]), F.lit(0.0))
        out[f"{name}_points"] = score
    return out


def nearest(values: Column, times: Column, to: Column) -> Column:
    """Of two parallel arrays, the value whose time is nearest to `to`; the earlier one of two as near."""
    pairs = F.arrays_zip(times.alias("t"), values.alias("v"))
    ranked = F.transform(pairs, lambda p: F.struct(F.abs(p["t"] - to).alias("far"), p["t"].alias("t"), p["v"].alias("v")))
    return F.array_min(ranked)["v"]


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where either is missing or b is zero."""
    return F.try_divide(col(a), col(b))


def floor_at(c: str | Column, least: float = 0.0) -> Column:
    """Clip from below; null stays null."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(least)))


def category_order(c: str | Column, order: Sequence[str]) -> Column:
    """Position in a custom order, from 1; 0 for values not listed."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), col(c))


def band_score(c: str | Column, bands: Sequence[tuple[float | None, float]]) -> Column:
    """Score of the first band (upper limit, score) whose limit isn't below the value; a null limit takes the rest."""
    chain, value = F, col(c)
    for limit, score in bands:
        test = value.isNotNull() if limit is None else value <= limit
        chain = chain.when(test, F.lit(float(score)))
    return chain


def linear_score(weights: Mapping[str, float]) -> Column:
    """Sum of weight times value, missing values counting 0."""
    return reduce(add, (F.coalesce(F.col(c), F.lit(0)) * F.lit(float(w)) for c, w in weights.items()))


def flag_list(flags: Mapping[str, Column], sep: str = ";", default: str = "") -> Column:
    """Names of the flags that hold, joined; `default` where none does."""
    joined = F.concat_ws(sep, *[F.when(test, F.lit(name)) for name, test in flags.items()])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def confidence(games: str | Column, gap_days: str | Column, steps: Sequence[tuple[str, int, int]], lowest: str = "LOW", required: Column | None = None) -> Column:
    """First label of (label, least games, most days) that is met; a missing gap meets none. The first label also needs
    the `required` condition, if one is given."""
    chain = F
    for k, (label, least, most) in enumerate(steps):
        test = (col(games) >= least) & (col(gap_days) <= most)
        chain = chain.when(test & required if k == 0 and required is not None else test, label)
    return chain.otherwise(lowest)


def zoned_to_utc(date: str | Column, time: str | Column, zone: str) -> Column:
    """Timestamp in UTC of a local date and HH:mm time in a zone, with its daylight saving."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", col(date), col(time)), F.lit("yyyy-MM-dd HH:mm")), zone)


def is_finite(c: str | Column) -> Column:
    value = col(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
