"""Small Spark helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule: space and the ASCII controls 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a bucket filter, and how many of them may be taken: a filter is broadcast with at most that many longs, and
#: then lets through an eighth of other rows at most.
FILTER_SLOTS, FILTER_MOST = 1 << 23, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is set (tests, local runs)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts the lineage where a result is
    used more than once and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `materialize` wrote and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for at in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if at.rpartition("/")[2].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                with suppress(Exception):  # a folder that is gone already does no harm
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_crc_mod(col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % k


def slot_of(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_SLOTS))


def in_filter(df: DataFrame, slot: Column, members: DataFrame, member_slot: Column, flag: str) -> DataFrame:
    """Add boolean `flag`: whether a row's slot is one of the members' slots. Rows outside are certainly not
    members; rows inside may be, and callers settle them by a join. The broadcast side holds at most FILTER_MOST longs;
    where the members take more slots than that, every row is flagged and the callers' join does all the work.
    Columns of `df` whose names are `flag` or `_slot` are replaced."""
    slots = members.select(member_slot.alias("_slot")).distinct()
    if slots.limit(FILTER_MOST + 1).count() > FILTER_MOST:
        return df.withColumn(flag, F.lit(True))
    slots = slots.withColumn(flag, F.lit(True))
    return (
        df.drop(flag).withColumn("_slot", slot)
        .join(F.broadcast(slots), "_slot", "left")
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
        .drop("_slot")
    )


def running_total(df: DataFrame, by: list[str], slot: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running total of `value` within the groups `by`, in the order of `slot`, then `order`.

    Two levels, so that no task ever holds a whole group: totals by (group, slot), a prefix over the slots, and a
    window inside each slot. `slot` is a small integer that splits every group evenly, e.g. bits of a hash.
    The columns of `by` must not be null.
    """
    before = Window.partitionBy(*by).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(*by, slot)
        .agg(F.sum(value).alias("_sum"))
        .select(*by, slot, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, [*by, slot])
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def text_chunks(batches, column: str, most: int = 4 << 20):
    """From Arrow batches, (batch slice, its texts as UTF-8 bytes with null as empty), of about `most` bytes each,
    so that memory depends on neither the batch's row count nor its long texts (one text is never cut)."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = texts.fill_null(b"")
        start, held = 0, 0
        lengths = [len(x) for x in sizes.to_pylist()] if batch.num_rows == 1 else _lengths(sizes)
        for i, n in enumerate(lengths):
            held += n
            if held >= most or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), sizes.slice(start, i + 1 - start).to_pylist()
                start, held = i + 1, 0


def _lengths(binary) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(binary).to_pylist()
