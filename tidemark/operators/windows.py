"""Windows over an entity's earlier rows. Frames end one row before the current one, so a row never sees itself.

Keys and order columns are parameters; the order must end in a unique column. Windows over `key` and over `key` plus
season share one shuffle and one sort as long as the order starts with the season.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalar import flag, ratio
from tidemark.operators.selection import running_sums, sliced


class Prior:
    """Window specs of one entity history."""

    def __init__(self, key: Sequence[str], order: Sequence[str], season: str | None = None):
        self.key, self.order = list(key), list(order)
        self.all = Window.partitionBy(*key).orderBy(*order)
        self.season = Window.partitionBy(*key, *([season] if season else [])).orderBy(*order)

    def last(self, k: int) -> WindowSpec:
        return self.all.rowsBetween(-k, -1)

    @property
    def to_date(self) -> WindowSpec:
        return self.season.rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, c: str | Column) -> Column:
        return F.lag(c).over(self.all)

    def mean(self, c: str | Column, k: int) -> Column:
        return F.avg(c).over(self.last(k))

    def integer_mean(self, c: str, window: WindowSpec, scale: int = 4) -> Column:
        """Mean of whole numbers rounded half up to `scale` places in decimal arithmetic."""
        total = F.sum(F.col(c).cast("long")).over(window).cast("decimal(20,0)")
        return F.round(total / F.nullif(F.count(c).over(window), F.lit(0).cast("long")).cast("decimal(20,0)"), scale)

    def ratio_of_sums(self, a: str | Column, b: str | Column, k: int) -> Column:
        """Ratio of the two sums over the last k rows, not the mean of ratios; null for a zero denominator."""
        return ratio(F.sum(a).over(self.last(k)).cast("double"), F.sum(b).over(self.last(k)).cast("double"))

    def exact_mean(self, c: str | Column, k: int) -> Column:
        """Mean of a decimal column by its exact sum."""
        return ratio(F.sum(c).over(self.last(k)).cast("double"), F.count(c).over(self.last(k)))

    def count(self) -> Column:
        return F.row_number().over(self.all) - 1

    def season_count(self) -> Column:
        return F.row_number().over(self.season) - 1

    def flag_sum(self, c: str | Column, k: int) -> Column:
        return F.coalesce(F.sum(c).over(self.last(k)), F.lit(0))


def prior_features(df: DataFrame, prior: Prior, measures: Sequence[str], means: Sequence[int] = (3, 5), spread: int = 5) -> DataFrame:
    """For each measure: previous value, trailing means, season-to-date mean and deviation, trailing deviation, minimum and
    maximum; and the counts of earlier rows overall and in the season."""
    added = {}
    for m in measures:
        added[f"{m}_prev"] = prior.lag(m)
        for k in means:
            added[f"{m}_last{k}"] = prior.mean(m, k)
        added[f"{m}_season"] = F.avg(m).over(prior.to_date)
        added[f"{m}_sd{spread}"] = F.stddev_samp(m).over(prior.last(spread))
        added[f"{m}_min{spread}"] = F.min(m).over(prior.last(spread))
        added[f"{m}_max{spread}"] = F.max(m).over(prior.last(spread))
        added[f"{m}_season_sd"] = F.stddev_samp(m).over(prior.to_date)
    return df.withColumns(added | {"prior_rows": prior.count(), "prior_season_rows": prior.season_count()})


def anchors(df: DataFrame, prior: Prior, date: str, place: str, season: str) -> DataFrame:
    """What an entity's previous row was: its date, place and season, days since, and flags."""
    before = prior.lag(F.to_date(date))
    return df.withColumns(
        {
            "prev_date": before,
            "days_since": F.datediff(F.to_date(date), before),
            "place_changed": flag(prior.lag(place).isNotNull() & ~prior.lag(place).eqNullSafe(F.col(place))),
            "new_season": flag(prior.lag(season) < F.col(season)),
            "is_first": flag(prior.count() == 0),
            "has_three": flag(prior.count() >= 3),
        }
    )


def cutoff_features(history: DataFrame, targets: DataFrame, key: Sequence[str], order: Sequence[str], measure: str, before: Column, season: Column) -> DataFrame:
    """The same features for target rows that have no history row yet: from history rows where `before` holds, one row
    per key, joined left. `season` marks the rows of the target's own season."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    ranked = history.where(before).withColumn("_rank", F.row_number().over(newest))
    last = lambda k: F.when(F.col("_rank") <= k, F.col(measure))
    one = ranked.groupBy(*key).agg(
        F.max(last(1)).alias(f"{measure}_prev"),
        F.avg(last(3)).alias(f"{measure}_last3"),
        F.avg(last(5)).alias(f"{measure}_last5"),
        F.avg(F.when(season, F.col(measure))).alias(f"{measure}_season"),
        F.stddev_samp(last(5)).alias(f"{measure}_sd5"),
        F.min(last(5)).alias(f"{measure}_min5"),
        F.max(last(5)).alias(f"{measure}_max5"),
        F.stddev_samp(F.when(season, F.col(measure))).alias(f"{measure}_season_sd"),
        F.count("*").alias("prior_rows"),
        F.count_if(season).alias("prior_season_rows"),
    )
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("prior_rows", "prior_season_rows")}
    return targets.join(one, list(key), "left").withColumns(counts)


def cutoff_ratios(history: DataFrame, targets: DataFrame, key: Sequence[str], order: Sequence[str], before: Column, ratios: dict[str, tuple[str, str, int]], flags: dict[str, tuple[str, int]]) -> DataFrame:
    """Trailing ratios of sums and sums of flags at a cutoff: name to (numerator, denominator, rows) and (flag, rows)."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    ranked = history.where(before).withColumn("_rank", F.row_number().over(newest))
    last = lambda c, k: F.when(F.col("_rank") <= k, F.col(c))
    made = [ratio(F.sum(last(a, k)), F.sum(last(b, k))).alias(n) for n, (a, b, k) in ratios.items()]
    made += [F.coalesce(F.sum(last(c, k)), F.lit(0)).alias(n) for n, (c, k) in flags.items()]
    joined = targets.join(ranked.groupBy(*key).agg(*made), list(key), "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in flags})


def global_prior_mean(df: DataFrame, day: str, order: Sequence[str], value: str, out: str, strict_day: bool = False) -> DataFrame:
    """Mean of `value` over all earlier rows, of any entity. Two levels: sums by day with a prefix over the days, and a
    window inside the day; one row per day meets in a single task, never the rows themselves. With `strict_day`, rows of
    the same day don't count. Sums of a decimal `value` are exact in any order."""
    days = df.groupBy(day).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    base = days.select(day, F.sum("_s").over(before).alias("_bs"), F.sum("_n").over(before).alias("_bn"))
    inside = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    total, count = F.coalesce("_bs", zero), F.coalesce("_bn", zero)
    if not strict_day:
        total = total + F.coalesce(F.sum(value).over(inside), zero)
        count = count + F.count(value).over(inside)
    return df.join(base, day).withColumn(out, ratio(total.cast("double"), count)).drop("_bs", "_bn")


def spread_prior_features(df: DataFrame, key: Sequence[str], order: Sequence[str], season: str, measures: Sequence[str], means: Sequence[int] = (3, 5), spread: int = 5, size: int = 100_000) -> DataFrame:
    """`prior_features` for keys of any size (all but the season's deviation): trailing values within slices of a key that
    bring the few rows before them along, season-to-date means from running sums over ranges. No task sorts a whole key."""
    halo = max([spread, *means, 1])
    known = {f"_s_{m}": F.col(m).cast("decimal(38,6)") for m in measures} | {f"_c_{m}": F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in measures}
    rows = running_sums(df, [*key, season], order, known | {"prior_season_rows": F.lit(1)})
    p = Prior([*key, "_slice"], ["_n"])
    added = {}
    for m in measures:
        added[f"{m}_prev"] = p.lag(m)
        added |= {f"{m}_last{k}": p.mean(m, k) for k in means}
        added[f"{m}_season"] = ratio(F.col(f"_s_{m}").cast("double"), F.col(f"_c_{m}"))
        added |= {f"{m}_sd{spread}": F.stddev_samp(m).over(p.last(spread)), f"{m}_min{spread}": F.min(m).over(p.last(spread)), f"{m}_max{spread}": F.max(m).over(p.last(spread))}
    made = sliced(rows, key, order, halo, size).withColumns(added | {"prior_rows": F.col("_n") - 1}).where(~F.col("_halo"))
    return made.drop("_n", "_slice", "_halo", *known)
