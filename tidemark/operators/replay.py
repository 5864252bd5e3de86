"""Comparing two versions of a table by digests of key ranges first, so that equal parts are never moved."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import replay_difference

#: Ranges of key hashes. What leaves a task before rows are compared is one row a range; a list of them is broadcast.
RANGES = 4096


def _range(key: Sequence[str], ranges: int) -> Column:
    """A row's range; rows without a whole key are in a range of their own, -1."""
    unknown = reduce(lambda p, q: p | q, [F.col(k).isNull() for k in key])
    return F.when(unknown, -1).otherwise(F.pmod(F.xxhash64(*key), F.lit(ranges))).cast("long")


def range_digests(df: DataFrame, key: Sequence[str], values: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """range, n_rows and two digests, equal for equal rows in any order. A digest is a sum of 64-bit hashes, so that repeated
    rows don't cancel out and those of parts of a table add up. Nulls are hashed with a mark of theirs, since a hash passes over them."""
    marked = [x for v in values for x in (F.col(v), F.col(v).isNull())]
    one, two = F.xxhash64(*key, *marked), F.xxhash64(F.lit(1), *key, *marked)
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return df.groupBy(_range(key, ranges).alias("range")).agg(F.count("*").alias("n_rows"), total(one).alias("digest_1"), total(two).alias("digest_2"))


def differing_ranges(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """The ranges (at most `ranges` and -1) whose rows differ between two versions; -1 whenever there are rows without a key."""
    told = ["n_rows", "digest_1", "digest_2"]
    side = lambda df, name: range_digests(df, key, values, ranges).select("range", F.struct(*told).alias(name))
    both = side(old, "o").join(side(new, "n"), "range", "full_outer")
    return both.where(~F.col("o").eqNullSafe(F.col("n")) | (F.col("range") < 0)).select("range")


def rows_in(df: DataFrame, key: Sequence[str], chosen: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The rows of some ranges, found where they lie."""
    return df.withColumn("_range", _range(key, ranges)).join(F.broadcast(chosen.select(F.col("range").alias("_range"))), "_range", "left_semi").drop("_range")


def replay_by_ranges(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 1e-9, ranges: int = RANGES) -> DataFrame:
    """`replay_difference` for versions that are mostly equal: digests by range tell where rows differ, and only rows of those ranges
    are joined. Both tables are read twice and, where equal, nothing but the digests is shuffled.

    The result is that of `replay_difference` for whole, unique keys. Rows without a whole key are always compared (and so are on
    one side only). Ranges with equal rows are equal, whichever of their values are NaN or keys repeated. Two empty tables differ
    in nothing. Values whose types differ between the versions make all ranges differ, which costs time, not truth.
    """
    chosen = differing_ranges(old, new, key, values, ranges)
    few = lambda df: rows_in(df.select(*key, *values), key, chosen, ranges)
    return replay_difference(few(old), few(new), key, values, tolerance)
