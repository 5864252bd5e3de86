"""Ranks, quotas and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import numbered


def masked_rank(df: DataFrame, mask: Column, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds a dense sequence 1, 2, ... among the rows of a group where `mask` holds, null elsewhere; a group may have any size."""
    ok = F.coalesce(mask, F.lit(False))
    return numbered(df.where(ok), by, order, out).unionByName(df.where(~ok).withColumn(out, F.lit(None).cast("int")))


def fill_quotas(df: DataFrame, by: Sequence[str], position: str, eligible: Column, order: Sequence[Column], quota: Mapping[str, int], flex: Sequence[str], flex_quota: int) -> DataFrame:
    """Slots per position first, then flexible slots for the best of the rest among the flexible positions; adds
    position_rank, flex_rank and slot (STARTER, FLEX, BENCH, INELIGIBLE). Every group of `by` is filled by itself; without
    groups the whole table is one, which is ranked by ranges. `order` must be unique."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(position)), F.lit(0))
    marked = df.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    ranked = masked_rank(marked, F.col("_ok"), [*by, position], order, "position_rank")
    ranked = ranked.withColumn("_starts", F.coalesce(F.col("position_rank") <= limit, F.lit(False)))
    rest = F.col("_ok") & ~F.col("_starts") & F.col(position).isin(*flex)
    ranked = masked_rank(ranked, rest, by, order, "flex_rank")
    slot = (
        F.when(~F.col("_ok"), "INELIGIBLE").when(F.col("_starts"), "STARTER")
        .when(F.col("flex_rank") <= flex_quota, "FLEX").otherwise("BENCH")
    )
    return ranked.withColumn("slot", slot).drop("_ok", "_starts")


def slot_gaps(filled: DataFrame, by: Sequence[str], quota: Mapping[str, int], position: str, flex_quota: int = 0) -> DataFrame:
    """Per group and position, how many starters are missing; with a flex quota also how many flexible slots are."""
    if flex_quota:
        quota = {**quota, "FLEX": flex_quota}
        filled = filled.withColumn(position, F.when(F.col("slot") == "FLEX", "FLEX").otherwise(F.col(position)))
        filled = filled.withColumn("slot", F.when(F.col("slot") == "FLEX", "STARTER").otherwise(F.col("slot")))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias(position), F.lit(n).alias("required")) for p, n in quota.items()]))
    need = filled.select(*by).distinct().select(*by, wanted.alias("_w")).select(*by, "_w.*")
    have = filled.where("slot = 'STARTER'").groupBy(*by, position).agg(F.count("*").alias("filled"))
    joined = need.join(have, [*by, position], "left")
    return joined.select(*by, position, "required", F.coalesce("filled", F.lit(0).cast("long")).alias("filled")).withColumn("gap", F.col("required") - F.col("filled"))


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str | None = None) -> DataFrame:
    spec = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(out or "_rn", F.row_number().over(spec)).where(F.col(out or "_rn") <= n)
    return ranked if out else ranked.drop("_rn")


def stratified_sample(df: DataFrame, strata: Sequence[str], key: Sequence[str], quota: int, seed: int, extra: int = 0) -> DataFrame:
    """The same `quota` rows of each stratum on every run: in the order of a hash of key and seed. `extra` more rows come
    one each from the first strata in their own order, as the remainder of an uneven division does."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    taken = head_per_group(df, strata, [order, *[F.col(k) for k in key]], quota + (1 if extra else 0), "_rn")
    if extra:
        firsts = df.select(*strata).distinct().orderBy(*strata).limit(extra).withColumn("_more", F.lit(1))
        taken = taken.join(F.broadcast(firsts), list(strata), "left")  # `extra` rows
        taken = taken.where(F.col("_rn") <= quota + F.coalesce("_more", F.lit(0))).drop("_more")
    return taken.drop("_rn")


def with_unavailable(df: DataFrame, position: str, eligible: Column, unavailable: Column) -> DataFrame:
    """Columns for a lineup with overrides: `usable` (eligible and not unavailable) and `override`, which says why not."""
    gone = F.coalesce(unavailable, F.lit(False))
    ok = F.coalesce(eligible, F.lit(False))
    return df.withColumns({"usable": ok & ~gone, "override": F.when(gone, "UNAVAILABLE").when(~ok, "INELIGIBLE").otherwise("")})
