"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, running_total

#: Weights by rank of the source, repeating, and how often a document may be taken.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Slots (of a hash) that the documents of one source are spread over for their running totals.
SLOTS = 4096


def words_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, source_col: str = "source", name: Column | None = None) -> DataFrame:
    """Weighted fair queueing over the sources; returns one row per input row.

    Columns: the id, size, source_size, target, taken and copies (how often the document is served).
    Every source's documents are shuffled by the MD5 of their id (or of `name`) and may be served up to three times over. A copy's
    virtual finish time is the source's tokens so far divided by the source's weight. All copies are sorted by that
    time over the whole cluster (range partitions with prefix sums over the partitions) and cut where the total
    budget, the sum of all sizes, is used up. A source that runs out of copies leaves its share to the others, which
    is the resharing that `target` states in closed form.

    Times are exact integers (tokens times 6 / weight), so reruns agree bit by bit. No task holds a whole source.
    One row per source meets in one task for the targets; that is the number of sources, not of documents.

    Edge cases: null text has size 0 and is never taken; a null source is a source of its own, last in order;
    repeated ids are rows of their own; with no tokens at all every `taken` is 0; an empty table gives an empty
    result; other columns of the input are ignored, whatever their names.
    """
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        F.col(source_col).isNull().alias("_null"),
        (words_of() if size is None else size).alias("_size"),
        F.md5(F.coalesce((F.col(id_col) if name is None else name).cast("string"), F.lit(""))).alias("_md5"),
    )
    totals = materialize(base.groupBy("_src", "_null").agg(F.sum("_size").alias("_total")))
    shares = materialize(source_shares(totals))
    by = ["_src", "_null"]
    # the number of sources isn't bounded, so Spark decides how this small side travels
    queue = base.join(shares, by).withColumn("_slot4k", F.conv(F.substring("_md5", 1, 3), 16, 10).cast("int"))
    placed = running_total(queue, by, "_slot4k", [F.col("_md5"), F.col("_id"), F.col("_size")], "_size", "_before")
    placed = placed.withColumn("_end", F.col("_before") + F.col("_size"))
    placed = materialize(placed.drop("_md5", "_slot4k"))

    copies = placed.where("_size > 0").select(
        "_rank", "_size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1)), lambda e: _finish(e))).alias("_v")
    )
    served = materialize(copies.repartitionByRange("_v", "_rank").withColumn("_part", F.spark_partition_id()))
    parts = served.groupBy("_part").agg(F.sum("_size").alias("_sum"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_v", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    budget = totals.agg(F.sum("_total").alias("_budget"))
    cut = (
        served.withColumn("_run", F.sum("_size").over(inside))
        .join(parts, "_part")
        .crossJoin(F.broadcast(budget))  # one row
        .where(F.col("_base") + F.col("_run") <= F.col("_budget"))
        .agg(F.max(F.struct("_v", "_rank")).alias("_cut"))
    )
    takes = sum(
        (F.when(F.struct(_finish(F.lit(e)).alias("_v"), F.col("_rank")) <= F.col("_cut"), 1).otherwise(0) for e in range(MOST_COPIES)),
        F.lit(0),
    )
    takes = F.when((F.col("_size") > 0) & F.col("_cut").isNotNull(), takes).otherwise(0)
    return placed.crossJoin(F.broadcast(cut)).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * takes).cast("long").alias("taken"),
        takes.cast("int").alias("copies"),
    )


def _finish(epoch: Column) -> Column:
    """Virtual finish time of a document's copy in the given pass over its source, times 6."""
    return (epoch * F.col("_total") + F.col("_end")) * (F.lit(6) / F.col("_weight")).cast("long")


def source_shares(totals: DataFrame) -> DataFrame:
    """Rank, weight and target of each source. Targets share the sum of all sizes by weight and stop at
    MOST_COPIES times the source's size; the level at which the rest is shared is found by one pass in the
    order in which the sources fill up."""
    order = Window.orderBy("_null", "_src")
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    upto, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = totals.withColumn("_rank", F.row_number().over(order)).withColumns(
        {
            "_weight": F.element_at(weights, (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")),
            "_cap": MOST_COPIES * F.col("_total"),
            "_all": F.sum("_total").over(whole),
        }
    )
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / F.sum("_weight").over(rest)
    ranked = ranked.withColumn("_level", level)
    reached = F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(whole)
    return ranked.withColumn("_fill", reached).select(
        "_src",
        "_null",
        "_rank",
        "_weight",
        "_total",
        F.round(F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_fill"), F.lit(0.0)) * F.col("_weight")), 6).alias("_target"),
    )
