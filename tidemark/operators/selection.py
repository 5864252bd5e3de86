"""Exact order statistics, ranks and numberings of groups of any size: no group's rows meet in one place.

A quantile sketch (of bounded size, with a proven error of rank) gives a narrow range that must hold the wanted value; rows
below the range are only counted, those inside are counted by value, and only these counts are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import kept

#: The sketch's error of rank is at most a group's rows / ACCURACY. Groups of up to 4 * ACCURACY rows take their whole range.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], shares: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """Per group, exact quantiles by linear interpolation between the two nearest values, under the names of `values` (with several
    shares: name_0, name_1, ...). Nulls don't count; a group without values gets nulls.

    Null keys are a group of their own. An empty table gives an empty result.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_v")) for n, v in values.items()]))
    keyed = df.select(F.struct(*by).alias("_k"), stacked.alias("_s")).select("_k", "_s.*")
    around = [min(1.0, max(0.0, s + d / accuracy)) for s in shares for d in (-3, 3)]
    sketch = keyed.groupBy("_k", "_name").agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", around, accuracy).alias("_q")
    )
    whole = F.col("_n") <= 4 * accuracy
    ends = [F.struct(F.lit(i).alias("i"), F.lit(s).alias("p"), F.when(whole, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"), F.when(whole, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi")) for i, s in enumerate(shares)]
    ranges = sketch.select("_k", "_name", "_n", F.array(*ends).alias("_ends"))
    # a row counts for each share whose range it is in or below; those below all count as one value, null
    near = F.explode(F.filter("_ends", lambda e: F.col("_v") <= e["hi"]))
    # every row has its range; a left join, so that Spark, which doesn't see what explode adds, never broadcasts the rows
    met = keyed.where("_v is not null").join(ranges, ["_k", "_name"], "left").select("_k", "_name", "_n", "_v", near.alias("e"))
    counted = met.groupBy("_k", "_name", "_n", F.col("e.i").alias("i"), F.col("e.p").alias("p"), F.when(F.col("_v") >= F.col("e.lo"), F.col("_v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_k", "_name", "i").orderBy(F.col("v").asc_nulls_first()))
    place = (F.col("_n") - 1) * F.col("p")
    least = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    found = (
        counted.withColumns({"upto": upto, "place": place})
        .groupBy("_k", "_name", "i").agg(least(F.floor("place")).alias("a"), least(F.ceil("place")).alias("b"), F.max(F.col("place") - F.floor("place")).alias("f"))
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    name = lambda n, i: n if len(shares) == 1 else f"{n}_{i}"
    picked = [F.max(F.when((F.col("_name") == n) & (F.col("i") == i), value)).alias(name(n, i)) for n in values for i in range(len(shares))]
    counts = [F.max(F.when(F.col("_name") == next(iter(values)), F.col("_n"))).alias("_n")]
    groups = sketch.groupBy("_k").agg(*counts)
    return groups.join(found.groupBy("_k").agg(*picked), "_k", "left").select("_k.*", *[name(n, i) for n in values for i in range(len(shares))])


def parted(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """`df` in ranges of (by, order), each sorted, so that a large group is spread over many. Adds _k (the group), _id, which
    rises with the order over all ranges, and _part. Written once: another run might draw the ranges otherwise."""
    own = [*by, *order]
    ranged = df.withColumn("_k", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))).repartitionByRange(*own).sortWithinPartitions(*own)
    return kept(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """Rows numbered from 1 within the groups `by` in any order that is unique. Two levels: counts by group and range, of
    which one row each meets in a window; a row's own number is its distance from the first of its range."""
    rows = parted(df, by, order)
    counts = rows.groupBy("_k", "_part").agg(F.count("*").alias("_c"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_k", "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    joined = rows.join(bases, ["_k", "_part"])
    return joined.withColumn(out, (F.col("_base") + F.col("_id")).cast("int")).drop("_k", "_id", "_part", "_base")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: Mapping[str, Column | str]) -> DataFrame:
    """Under each name, the sum of a value over the rows before each one in its group, in the same two levels; inside a range by
    a window. Sums of nothing are 0."""
    rows = parted(df.withColumns({f"_v_{n}": F.col(v) if isinstance(v, str) else v for n, v in values.items()}), by, order)
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_k", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = rows.groupBy("_k", "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    bases = sums.select("_k", "_part", *[total(f"_s_{n}", before).alias(f"_b_{n}") for n in values])
    own = rows.withColumns({f"_o_{n}": total(f"_v_{n}", inside) for n in values}).join(bases, ["_k", "_part"])
    made = own.withColumns({n: F.col(f"_b_{n}") + F.col(f"_o_{n}") for n in values})
    return made.drop("_k", "_id", "_part", *[f"_{x}_{n}" for x in "vbo" for n in values])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    return running_sums(df, by, order, {out: value})


def last_known(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, out: str) -> DataFrame:
    """The last value that isn't null at or before each row in its group: within a range by a window, and what the ranges before
    have seen last is carried over, one row for a range."""
    rows = parted(df, by, order)
    known = F.col(value).isNotNull()
    ends = rows.groupBy("_k", "_part").agg(F.max_by(value, F.when(known, F.col("_id"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_k", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(carried, ["_k", "_part"])
    return own.withColumn(out, F.coalesce("_own", "_carried")).drop("_k", "_id", "_part", "_own", "_carried")


def sliced(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], halo: int, size: int) -> DataFrame:
    """Each group in slices of `size` rows of its order, and before each slice the last `halo` rows of the one before: _n (the
    row's number), _slice, _halo (the row only serves the slice). Windows of up to `halo` rows back then go by slice."""
    if size < halo:
        raise ValueError("a slice must be as large as its halo")
    rows = numbered(df, by, order, "_n")
    own = F.floor((F.col("_n") - 1) / size)
    both = F.when((F.col("_n") - 1) % size >= size - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_own", own).withColumn("_slice", F.explode(both)).withColumn("_halo", F.col("_slice") > F.col("_own")).drop("_own")


def average_ranks(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """by, _side, _v, _rank: the rank of every distinct value of each column (side to column), ties averaged. Rows are counted by
    value first, for all sides in one pass; then counts add up in order."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("_side"), F.col(c).cast("double").alias("_v")) for s, c in values.items()]))
    counted = df.select(*by, sides.alias("_s")).select(*by, "_s.*").groupBy(*by, "_side", "_v").agg(F.count("*").alias("_c"))
    return running_sum(counted, [*by, "_side"], ["_v"], "_c", "_before").select(*by, "_side", "_v", (F.col("_before") + (F.col("_c") + 1) / 2).alias("_rank"))
