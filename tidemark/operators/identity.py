"""Deduplication, latest records and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import all_available


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    spec = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).where("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: Sequence[str], time: str, tie: Sequence[Column] = ()) -> DataFrame:
    """The row with the latest time of each key, missing times last. Rows whose key is incomplete stay as they are."""
    known = all_available(*key)
    latest = first_per_key(df.where(known), key, [F.col(time).desc_nulls_last(), *tie])
    return latest.unionByName(df.where(~known))


def latest_guarded(df: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """`latest_per_key` that raises ValueError while repeated keys have no time or share their latest one."""
    if not latest_violations(df.where(all_available(*key)), key, time).isEmpty():
        raise ValueError(f"keys {list(key)} repeat without a single latest {time}")
    return latest_per_key(df, key, time)


def latest_violations(df: DataFrame, key: Sequence[str], time: str) -> DataFrame:
    """Keys that occur more than once and have no time at all, or share their latest time among several rows."""
    # pre-aggregated by key and time, so that a frequent key is one row per time
    times = df.groupBy(*key, time).agg(F.count("*").alias("_n"))
    grouped = times.groupBy(*key).agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col(time).isNotNull(), F.col("_n"))), F.lit(0).cast("long")).alias("n_dated"),
        F.coalesce(F.max_by("_n", time), F.lit(0).cast("long")).alias("n_latest"),
    )
    return grouped.where("n_rows > 1 and (n_dated = 0 or n_latest > 1)")


def resolve_ids(df: DataFrame, own: str, given: str, out: str = "resolved_id") -> DataFrame:
    """The first known of two ids, which one it came from, and whether they disagree."""
    return df.withColumns(
        {
            out: F.coalesce(own, given),
            f"{out}_source": F.when(F.col(own).isNotNull(), "own").when(F.col(given).isNotNull(), "given").otherwise("none"),
            f"{out}_conflict": F.when(F.col(own).isNotNull() & F.col(given).isNotNull() & (F.col(own) != F.col(given)), 1).otherwise(0),
        }
    )
