"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, in_filter, materialize, slot_of, text_or_empty


def progressive_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False
) -> DataFrame:
    """Group texts that are identical once white space is deleted; return one row per input row.

    Columns: the id, keep_id, group_size, kept, full_hash (SHA-256 of the normalised text; null for rows that an
    earlier step settled, unless `digest_all`). The row with most code points in the original text stays, then
    the one with the smallest id.

    Steps: (1) one scan takes length and prefix hash of the normalised text; lengths that occur once are settled;
    (2) of the others, pairs of length and prefix hash that occur once are settled; (3) a second scan takes the
    full hash of the texts that survive, and only those digests are shuffled, never texts. Survivors are told by
    a bucket filter of fixed size; a row that it lets through needlessly is only hashed in vain.

    Edge cases: null text counts as empty; all empty or blank texts are one group; a null id sorts first; rows
    that repeat both id and text are in one group and each count (all of them have kept true if their id stays);
    an empty table gives an empty result; other columns of the input are ignored, whatever their names.
    """
    text = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    norm = text.select("_id", F.length("_text").alias("_chars"), F.regexp_replace("_text", WHITE, "").alias("_norm"))
    shape = norm.select(
        F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix")
    ).groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    shape = materialize(shape)
    lengths = shape.groupBy("_len").agg(F.sum("_n").alias("_n")).where("_n > 1")
    by_length = in_filter(shape, slot_of("_len"), lengths, slot_of("_len"), "_open").where("_open")
    by_prefix = by_length.where("_n > 1")

    keyed = norm.select(
        "*", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix")
    )
    keyed = in_filter(keyed, slot_of("_len", "_prefix"), by_prefix, slot_of("_len", "_prefix"), "_open")
    needed = F.lit(True) if digest_all else F.col("_open")
    rows = materialize(
        keyed.select("_id", "_chars", "_open", F.when(needed, F.unhex(F.sha2("_norm", 256))).alias("_hash"))
    )
    groups = materialize(
        rows.where("_open")
        .groupBy("_hash")
        .agg(F.count("*").alias("_size"), F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").alias("i"))).alias("_best"))
        .where("_size > 1")
        .select("_hash", "_size", F.col("_best.i").alias("_keep"))
    )
    # settled rows have no partner and, unless all are digested, no hash: they stay out of the join
    alone = rows.where("not _open").select("_id", "_hash", F.lit(None).cast("long").alias("_size"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_keep"))
    joined = rows.where("_open").join(groups, "_hash", "left").select("_id", "_hash", "_size", "_keep").unionByName(alone)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_hash")).alias("full_hash"),
    )
