"""A corpus pipeline of five operators: toxic documents go, then exact copies, then near copies; what is left is mixed by
source and packed into training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of `documents`. doc_id and text together identify a document, so that rows with a null doc_id, or with one doc_id and
different texts, are documents of their own. Edge cases in every stage: null and empty texts are documents like others
(blank ones are exact copies of each other; mixing never serves a text without words); a very long text is read whole;
extra columns of the input travel along whatever their names, since a row travels as one value beside the stage's own
columns; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_crc_mod, in_filter, shared_dir, slot_of
from tidemark.llm.exact_dedup import progressive_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.toxicity import score_toxicity, train_toxicity


def _columns(names: list[str], of: str = "") -> list[Column]:
    return [F.col(f"{of}`{c}`") for c in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't call toxic. It's fitted on this stage's own input, on
    labels of documents outside the held-out fold."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_crc_mod("id", 5) != 0)
    others = [c for c in docs.columns if c != "text"]
    scored = score_toxicity(docs.select(F.struct(*_columns(others)).alias("row"), "text"), model)
    return scored.where("predicted = 0").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns as one value), key, text and source. The key is never null and sorts by doc_id first; nulls
    inside a struct equal each other in joins."""
    key = F.struct(F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return docs.select(F.struct(*_columns(docs.columns)).alias("row"), key.alias("key"), "text", "source")


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """row and key of documents whose key isn't in `dropped`. Only rows that a bucket filter can't clear are shuffled."""
    told = in_filter(keyed.select("row", "key"), slot_of("key"), dropped, slot_of("key"), "maybe")
    unsure = told.where("maybe").join(dropped.distinct(), "key", "left_anti")
    return told.where("not maybe").select("row", "key").unionByName(unsure.select("row", "key"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies; rows that repeat doc_id and text are one, the first by its other columns."""
    keyed = _keyed(docs)
    found = progressive_dedup(keyed, id_col="key")
    kept = _without(keyed, found.where("not kept").select("key"))
    again = found.where("kept").groupBy("key").count().where("count > 1").select("key")
    told = in_filter(kept, slot_of("key"), again, slot_of("key"), "maybe")
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    once = told.where("maybe").groupBy("key").agg(F.min_by("row", others).alias("row"))
    return told.where("not maybe").select("row").unionByName(once.select("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: similarity of at least 0.8 on shingles of five words."""
    keyed = _keyed(docs)
    return _without(keyed, near_duplicates(keyed, id_col="key", width=5).where("not kept").select("key")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a document appears as often as it's served, up to three times."""
    keyed = _keyed(docs)
    # documents without an id are dealt by their texts, or they'd all share one place in the queue
    name = F.coalesce(F.col("key.id").cast("string"), F.hex("key.digest"))
    served = mix_sources(keyed, id_col="key", name=name).where("copies > 0").groupBy("key").agg(F.max("copies").alias("copies"))
    repeated = keyed.select("row", "key").join(served, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Models, hashed similarity and tokenization aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}")
        docs = spark.read.parquet(path)
    return docs
