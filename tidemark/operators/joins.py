"""Joins with stated cardinality, key reconciliation and as-of joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import last_known


def matched_join(left: DataFrame, right: DataFrame, on: Sequence[str], out: str = "match_status") -> DataFrame:
    """Left join with a column that says `matched` or `unmatched`."""
    marked = right.withColumn("_there", F.lit(1))
    joined = left.join(marked, list(on), "left")
    return joined.withColumn(out, F.when(F.col("_there").isNotNull(), "matched").otherwise("unmatched")).drop("_there")


def coverage(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per segment, rows and the percentage of them with a partner; the right side must have unique keys."""
    joined = left.join(right.select(*on).withColumn("_there", F.lit(1)), list(on), "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n_rows"), F.round(100.0 * F.count("_there") / F.count("*"), 2).alias("percent"))


def cardinality(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: repeated keys on either side, and keys without a partner on either side."""
    keys = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
    both = keys(left, "l").join(keys(right, "r"), list(on), "full_outer")
    return both.agg(
        F.count_if(F.col("l") > 1).alias("left_repeated"),
        F.count_if(F.col("r") > 1).alias("right_repeated"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
    )


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", kind: str = "many_to_one") -> DataFrame:
    """Join after checking that the sides said to be unique are; raises ValueError otherwise. The check is one extra
    aggregate per side and is run at once: a side that is expensive to compute should be written before."""
    for side, name, wanted in ((left, "left", kind.startswith("one")), (right, "right", kind.endswith("one"))):
        if wanted and not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{kind}: the {name} side repeats keys {list(on)}")
    return left.join(right, list(on), how)


def disagreements(left: DataFrame, right: DataFrame, on: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows whose keys agree and whose attributes don't: one row per name in `pairs` (left column, right column) that
    differs, nulls being equal to each other only."""
    joined = left.join(right, list(on))
    found = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.struct(F.lit(n).alias("attribute"), F.col(a).cast("string").alias("left_value"), F.col(b).cast("string").alias("right_value"))) for n, (a, b) in pairs.items()]))
    return joined.select(*on, F.explode(found).alias("_f")).select(*on, "_f.*")


def key_differences(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    named = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), list(on), "full_outer")
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right")
    return named.withColumn("only_in", side).where("only_in is not null").drop("_l", "_r")


def asof_group_snapshot(df: DataFrame, group: Sequence[str], entity: Sequence[str], time: str, cutoff: Column, keep: Column, order: Sequence[Column]) -> DataFrame:
    """Each group's newest snapshot at or before the cutoff, then the rows of it that pass `keep`, then each entity's
    first. An entity that the group's newest snapshot lacks is gone, even if older ones have it."""
    known = df.where(F.col(time) <= cutoff)
    newest = known.groupBy(*group).agg(F.max(time).alias("_newest"))
    rows = known.join(newest, list(group)).where(F.col(time) == F.col("_newest")).where(keep).drop("_newest")
    spec = Window.partitionBy(*group, *entity).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(spec)).where("_rn = 1").drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, out: str, tie: str, spread: bool = False) -> DataFrame:
    """Each left row with the latest right value at or before its own time: both sides in one sort, and the last value
    seen; no range join. `tie` orders right rows of one time. `spread`: for keys with very many rows; a key's times are cut into
    ranges, and the last value seen is carried from one to the next."""
    names = [c for c in left.columns if c not in by]
    facts = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"),
                        F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*names).alias("_row"))
    marks = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_v"),
                         F.lit(None).cast(facts.schema["_row"].dataType).alias("_row"))
    if spread:
        return last_known(facts.unionByName(marks), by, ["_t", "_side", "_tie"], "_v", out).where("_side = 1").select(*by, "_row.*", out)
    spec = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = facts.unionByName(marks).withColumn(out, F.last("_v", ignorenulls=True).over(spec))
    return seen.where("_side = 1").select(*by, "_row.*", out)
