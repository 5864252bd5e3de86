"""Distinct counts that can be stored by period and merged over periods, beside the exact way."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's slots, and the relative standard error which that many slots are good for.
LG_SLOTS = 14
STANDARD_ERROR = 1.04 / 2 ** (LG_SLOTS / 2)


def _known(columns: Sequence[str]) -> Column:
    """Whether all parts of a composite value are there: others don't count, as in a distinct count over several columns."""
    return reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in columns])


def distinct_sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], lg_slots: int = LG_SLOTS) -> DataFrame:
    """(by, sketch): one sketch of some 2^lg_slots bytes for each group, made in the tasks and merged after the shuffle, whatever
    the group's size. A table to store: later periods are added to it without reading earlier rows again."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.when(_known(columns), F.xxhash64(*columns)), F.lit(lg_slots)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger groups from those of their parts: values in several parts count once."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """The sketch replaced by how many distinct values it has seen, to the nearest whole number."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def exact_distinct(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """The exact counts, which move every distinct value once; no group meets in one task before its values are counted."""
    known = df.where(_known(columns)).select(*by, F.struct(*columns).alias("_v")).distinct()
    groups = df.select(*by).distinct() if by else None
    counted = known.groupBy(*by).agg(F.count("*").alias(name))
    if groups is None:
        return counted
    same = [groups[c].eqNullSafe(counted[c]) for c in by]
    return groups.join(counted, same, "left").select(*[groups[c] for c in by], F.coalesce(name, F.lit(0).cast("long")).alias(name))
