"""Data-quality checks as rows: check, expected, actual, difference, status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted_checks(df: DataFrame, violations: Mapping[str, Column], passed: str = "PASS", failed: str = "FAIL", expected: Mapping[str, int] | None = None) -> DataFrame:
    """Many checks in one scan: for each name, in how many rows the condition holds against how often it may (0)."""
    wanted = expected or {}
    one = df.agg(*[F.count_if(c).alias(name) for name, c in violations.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(wanted.get(n, 0)).cast("long").alias("expected"), F.col(n).alias("actual")) for n in violations])
    return verdicts(one.select(F.explode(pairs).alias("_c")).select("_c.*"), passed, failed)


def verdicts(rows: DataFrame, passed: str = "PASS", failed: str = "FAIL") -> DataFrame:
    return rows.withColumns(
        {"difference": F.col("actual") - F.col("expected"), "status": F.when(F.col("actual") == F.col("expected"), passed).otherwise(failed)}
    )


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("actual")).select(F.lit(n).alias("check_name"), F.lit(expected[n]).cast("long").alias("expected"), "actual") for n, df in tables.items()]
    return verdicts(reduce(DataFrame.unionByName, parts))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row on how a key repeats: groups, rows in them, rows too many, most rows of a key."""
    grouped = df.groupBy(*key).count()
    many = F.col("count") > 1
    zero = F.lit(0).cast("long")
    return grouped.agg(
        F.count_if(many).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(many, F.col("count"))), zero).alias("rows_in_repeated"),
        F.coalesce(F.sum(F.when(many, F.col("count") - 1)), zero).alias("excess_rows"),
        F.coalesce(F.max("count"), zero).alias("most_per_key"),
    )


def null_profile(df: DataFrame, ranges: bool = False, top: int | None = None) -> DataFrame:
    """Nulls per column, from one scan; with `ranges` also least and greatest value as text; only the `top` columns with
    most nulls if given."""
    made = [F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("n"), F.min(f"`{c}`").cast("string").alias("a"), F.max(f"`{c}`").cast("string").alias("b")).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("_rows"), *made)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`.n").alias("n_null"), F.col(f"`{c}`.a").alias("least"), F.col(f"`{c}`.b").alias("greatest")) for c in df.columns])
    rows = one.select(F.col("_rows").alias("n_rows"), F.explode(pairs).alias("_p")).select("_p.*", "n_rows")
    rows = rows if ranges else rows.drop("least", "greatest")
    return rows if top is None else rows.orderBy(F.col("n_null").desc(), "column_name").limit(top)


def replay_difference(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Two versions of a table compared by key: mismatching rows per column (fractions within a tolerance, all other types
    exactly, nulls equal to each other), rows of one side only, and rows with any difference."""
    joined = old.select(*key, *[F.col(v).alias(f"o_{v}") for v in values], F.lit(1).alias("_o")).join(
        new.select(*key, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(1).alias("_n")), list(key), "full_outer"
    )
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()

    numeric = {f.name for f in old.schema if f.dataType.simpleString() in ("double", "float") or f.dataType.simpleString().startswith("decimal")}

    def differs(v: str) -> Column:
        a, b = F.col(f"o_{v}"), F.col(f"n_{v}")
        if v not in numeric:
            return both & ~a.eqNullSafe(b)
        return both & ((a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False)))

    checks = {v: differs(v) for v in values} | {"only_old": F.col("_n").isNull(), "only_new": F.col("_o").isNull()}
    checks["any_row"] = reduce(lambda p, q: p | q, checks.values())
    return counted_checks(joined, checks)


def readiness(checks: DataFrame, blocking: Sequence[str] | None = None) -> DataFrame:
    """One row: READY if all (blocking) checks pass."""
    rows = checks if blocking is None else checks.where(F.col("check_name").isin(*blocking))
    failed = rows.agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") != "PASS").alias("n_failed"))
    return failed.withColumn("verdict", F.when(F.col("n_failed") == 0, "READY").otherwise("BLOCKED"))


def one_to_one(df: DataFrame, maps: Mapping[str, tuple[str, str]]) -> DataFrame:
    """For each map (name: two columns), how many left values have several right ones and the other way round."""
    parts = []
    for name, (a, b) in maps.items():
        pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
        for side, other in (("a", "b"), ("b", "a")):
            many = pairs.groupBy(side).count().where("count > 1").agg(F.count("*").alias("actual"))
            parts.append(many.select(F.lit(f"{name}_{side}_to_many_{other}").alias("check_name"), F.lit(0).cast("long").alias("expected"), "actual"))
    return verdicts(reduce(DataFrame.unionByName, parts))


def register(risks: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Named risks with the rows affected and the action they call for; NONE where no row is affected."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("risk"), "n_rows", F.lit(action).alias("action")) for n, (df, action) in risks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("action", F.when(F.col("n_rows") > 0, F.col("action")).otherwise("NONE"))


def rank_set_violations(df: DataFrame, by: Sequence[str], rank: str) -> Column:
    """Aggregate condition: the ranks of a group aren't exactly 1 to n."""
    known = F.count(rank)
    return (known > 0) & ((F.min(rank) != 1) | (F.max(rank) != known) | (F.count_distinct(rank) != known))


def parity(old: DataFrame, new: DataFrame, key: Sequence[str], category: str, value: str, tolerance: float) -> DataFrame:
    """Two versions of a prediction by key: rows, missing rows, mismatches, largest and mean difference, per category
    and for ALL."""
    joined = old.select(*key, category, F.col(value).alias("_o")).join(new.select(*key, F.col(value).alias("_n")), list(key), "left")
    gap = F.abs(F.col("_o") - F.col("_n"))
    grouped = joined.rollup(category).agg(
        F.grouping(category).alias("_all"), F.count("*").alias("n_rows"), F.count_if(F.col("_n").isNull() & F.col("_o").isNotNull()).alias("n_missing"),
        F.count_if(gap > tolerance).alias("n_mismatch"), F.max(gap).alias("max_difference"), F.avg(gap).alias("mean_difference"),
    )
    named = grouped.withColumn(category, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(category))).drop("_all")
    return named.withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_mismatch") == 0), "PASS").otherwise("FAIL"))


def period_gate(rows: DataFrame, completed: DataFrame, expected: DataFrame, entity: str, season: str, period: str, target: tuple[int, int]) -> DataFrame:
    """What must hold for a published period: all rows are of the target season and period, completed results hold nothing of that
    period or later, and every entity that `expected` names for an earlier period of the season has a completed result."""
    at_season, at_period = target
    later = (F.col(season) > at_season) | ((F.col(season) == at_season) & (F.col(period) >= at_period))
    prior = (F.col(season) == at_season) & (F.col(period) < at_period)
    covered = expected.where(prior).select(entity, season, period).distinct().join(completed.select(entity, season, period), [entity, season, period], "left_anti")
    parts = [
        counted_checks(rows, {"other_season": F.col(season) != at_season, "other_period": (F.col(season) == at_season) & (F.col(period) != at_period)}),
        counted_checks(completed, {"completed_not_before": later}),
        counted_checks(covered, {"prior_not_covered": F.lit(True)}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
