"""Fact tables: sums with conditional sources, opponents' rows, bucket sums, unified formats, period-grain crosswalks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import checked_join


def conditional_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """Many sums of one scan, each over the rows where its own condition holds (None: all rows); 0 where none does."""
    pick = lambda value, test: value if test is None else F.when(test, value)
    zero = F.lit(0)
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(pick(v, c)), zero).alias(name) for name, (v, c) in sums.items()])


def with_opponent(facts: DataFrame, event: Sequence[str], side: str, other: str, values: Sequence[str], prefix: str = "opponent_") -> DataFrame:
    """Each side's fact beside the other side's values; null where the other side has no row."""
    theirs = facts.select(*event, F.col(side).alias(other), F.col(other).alias(side), *[F.col(v).alias(prefix + v) for v in values])
    return facts.join(theirs, [*event, side, other], "left")


def bucket_sums(df: DataFrame, by: Sequence[str], value: Column, buckets: Mapping[str, Column], total: str) -> DataFrame:
    """Sum per bucket, the total, and `parts_gap`: how far the buckets' sum is from the total."""
    sums = conditional_sums(df, by, {total: (value, None)} | {name: (value, test) for name, test in buckets.items()})
    return sums.withColumn("parts_gap", F.col(total) - reduce(add, (F.col(b) for b in buckets)))


def profile_columns(df: DataFrame, keep: Sequence[str], profile: str, names: Sequence[str]) -> DataFrame:
    """One profile's columns (`profile_name`) under the plain names."""
    return df.select(*keep, *[F.col(f"{profile}_{n}").alias(n) for n in names])


def unify(formats: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], planned: Mapping[str, str], source: str = "format") -> DataFrame:
    """Tables of several formats as one: each maps planned names to expressions, missing names become typed nulls."""
    parts = [
        df.select(F.lit(name).alias(source), *[made.get(c, F.lit(None)).cast(t).alias(c) for c, t in planned.items()])
        for name, (df, made) in formats.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def event_sides(df: DataFrame, event: Sequence[str], side: Column, date: Column, sep: str = " @ ") -> DataFrame:
    """Events with exactly two distinct sides, in one formatted row each: sides in order, and the first date."""
    grouped = df.groupBy(*event).agg(F.array_sort(F.collect_set(side)).alias("_s"), F.min(date).alias("_d"))
    return grouped.where(F.size("_s") == 2).select(*event, F.array_join("_s", sep).alias("sides"), F.date_format("_d", "EEE dd MMM yyyy").alias("shown_date"))


def period_crosswalk(df: DataFrame, key: Sequence[str], period: str, id_col: str, tie: Sequence[Column]) -> DataFrame:
    """Which id a key had in each period (by `tie` if several), so that a present id isn't applied to the past."""
    spec = Window.partitionBy(*key, period).orderBy(*tie)
    known = df.where(F.col(id_col).isNotNull()).withColumn("_rn", F.row_number().over(spec))
    return known.where("_rn = 1").select(*key, period, id_col)


def preferred_lookup(df: DataFrame, lookups: Sequence[tuple[DataFrame, str]], value: str, out: str) -> DataFrame:
    """`value` by the first lookup (frame, key column) that knows the row's key; a row that none knows raises, and so does a
    lookup that repeats a key (which would repeat rows)."""
    names = []
    for k, (frame, key) in enumerate(lookups):
        df = checked_join(df, frame.select(key, F.col(value).alias(f"_l{k}")), [key], "left")
        names.append(f"_l{k}")
    missing = F.raise_error(F.concat_ws(" ", F.lit(f"no {value} for"), *[F.col(key).cast("string") for _, key in lookups]))
    return df.withColumn(out, F.coalesce(*names, missing.cast(df.schema[names[0]].dataType))).drop(*names)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Sum of value times weight over the weights of known values."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
