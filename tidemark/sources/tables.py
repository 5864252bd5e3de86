"""Contracts, readers, sinks and order-free fingerprints of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def select_contract(df: DataFrame, planned: Mapping[str, str], required: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The planned columns (name to type) in order; missing optional ones become typed nulls and are reported."""
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"required columns are missing: {lost}")
    missing = [c for c in planned if c not in df.columns]
    return df.select(*[(F.lit(None) if c in missing else F.col(c)).cast(t).alias(c) for c, t in planned.items()]), missing


def contract_differences(spark: SparkSession, df: DataFrame, expected: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """One row on how the columns differ from an exact contract: set, order and forbidden names."""
    have = df.columns
    values = (
        ",".join(sorted(set(expected) - set(have))), ",".join(sorted(set(have) - set(expected))),
        ",".join(sorted(set(have) & set(forbidden))), len(have), list(expected) == have,
    )
    return spark.createDataFrame([values], "missing string, unexpected string, forbidden string, n_columns long, same_order boolean")


def read_history(spark: SparkSession, path: str, columns: Sequence[str], before: Column | None = None) -> DataFrame:
    """A partitioned Parquet dataset with merged schemas, pruned columns and a pushed filter."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return (df if before is None else df.where(before)).select(*columns)


def contract_states(df: DataFrame, expected: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """One row per expected or existing column: MISSING, FORBIDDEN, UNEXPECTED or PRESENT, and in how many rows it's known."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    state = lambda c: "MISSING" if c not in df.columns else "FORBIDDEN" if c in forbidden else "PRESENT" if c in expected else "UNEXPECTED"
    names = list(dict.fromkeys([*expected, *df.columns]))
    known = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(0).cast("long")
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(state(c)).alias("state"), known(c).alias("n_known")) for c in names])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def history_until(df: DataFrame, season: str, period: str, current: int, last: int) -> DataFrame:
    """All rows of earlier seasons, and those of the current one up to the period `last`; partition pruning applies."""
    return df.where((F.col(season) < current) | ((F.col(season) == current) & (F.col(period) <= last)))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], replace: bool = True) -> None:
    """Partitioned Parquet sink; refuses an existing target unless `replace`."""
    df.write.mode("overwrite" if replace else "errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str | Column], most: int = 1_000_000) -> None:
    """A small result as one CSV file in stable order; a result of over `most` rows is written sorted, in several files."""
    ordered = df.orderBy(*order)
    small = df.limit(most + 1).count() <= most
    (ordered.coalesce(1) if small else ordered).write.mode("overwrite").csv(path, header=True)


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each partition of `by`) that is equal for equal rows in any order: count, and XOR and sum of the first 32
    bits of md5 over the values as text, in the order of their names. All three add up over parts of a table, and any engine
    that writes values alike can repeat them."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h).alias("hash_sum"))


def publish_if_changed(df: DataFrame, path: str) -> bool:
    """Publish a table only if its content differs; says whether it did. Versions and pointer as in `snapshots`, with which it
    is read."""
    from tidemark.sources import snapshots

    return snapshots.publish(df, path) is not None


def reconcile_files(spark: SparkSession, path: str, manifest: DataFrame, by: Sequence[str], schema: str | None = None) -> DataFrame:
    """A partitioned dataset against its manifest (partition columns, n_rows, n_files): rows, files and, where `schema` is
    given (name:type,...), whether the dataset has exactly that one."""
    df = spark.read.parquet(path)
    per_file = df.withColumn("_file", F.input_file_name()).groupBy(*by, "_file").agg(F.count("*").alias("_n"))
    have = per_file.groupBy(*by).agg(F.sum("_n").alias("n_loaded"), F.count("*").alias("n_loaded_files"))
    joined = manifest.join(have, list(by), "full_outer")
    same = schema is None or schema == ",".join(f"{n}:{t}" for n, t in sorted(df.drop(*by).dtypes))
    ok = F.col("n_rows").eqNullSafe(F.col("n_loaded")) & F.col("n_files").eqNullSafe(F.col("n_loaded_files"))
    return joined.withColumn("status", F.when(ok & F.lit(same), "PASS").otherwise("FAIL"))


def reconcile_manifest(df: DataFrame, manifest: DataFrame, by: Sequence[str], stated: str) -> DataFrame:
    """Rows per partition against what a manifest states; partitions of one side only count as 0."""
    have = df.groupBy(*by).agg(F.count("*").alias("n_loaded"))
    joined = manifest.select(*by, F.col(stated).alias("n_stated")).join(have, list(by), "full_outer")
    zero = F.lit(0).cast("long")
    joined = joined.withColumns({"n_stated": F.coalesce("n_stated", zero), "n_loaded": F.coalesce("n_loaded", zero)})
    return joined.withColumn("status", F.when(F.col("n_stated") == F.col("n_loaded"), "PASS").otherwise("FAIL"))


def key_values(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """A run manifest: aggregates of one scan as (key, value) text rows."""
    one = df.agg(*[v.cast("string").alias(k) for k, v in values.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in values])
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")
