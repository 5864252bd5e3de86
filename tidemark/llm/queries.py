"""The registered queries: each applies one operator to its whole table and derives the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, conversations, exact_dedup, langid, media, mixing, near_dedup, packing, pii, spelling, suffix_lm, toxicity, warc
from tidemark.llm.common import id_crc_mod, materialize
from tidemark.llm.oracle import ORACLE

TOKENIZER, RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pii.labelled_table(docs)
    model = pii.train_field([x for x, _ in rows], [y for _, y in rows])
    found = pii.find_personal_data(docs, model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    keyed = lambda s: F.struct(F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), keyed))
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(every).alias("spans"), F.size("added").alias("n_added"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), id_crc_mod("id", 5) != 0)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_windows", "n_toxic_windows")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.encode_media(table(spark, sf_dir, "documents")))  # written, then read back
    probed = media.probe_media(stored, digest=True)
    feature = F.concat_ws(
        "|", "codec", F.concat(F.col("timescale"), F.lit("Hz")), F.concat(F.col("duration"), F.lit("t")), F.concat(F.col("n_samples"), F.lit("s")),
        F.concat(F.col("n_chunks"), F.lit("c")), F.concat(F.col("n_sync"), F.lit("k")),
        F.concat(F.element_at("keyframes", -1)["start"], F.lit("-"), F.element_at("keyframes", -1)["end"]),
    )
    return probed.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
        "codec", "duration_s", "keyframes",
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train_language_model(docs, id_crc_mod("doc_id", 4) != 2)
    told = langid.predict_language(docs, model)
    return told.select("doc_id", (id_crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = suffix_lm.score_documents(docs, id_crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.progressive_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).drop("url")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words with their forms and roots. Edge cases as in `spelling.spelling_variants`."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the repair for every conversation, those that lose all rows among them. Edge cases as in
    `conversations.repair_conversations` and `conversations.damage`."""
    rows = table(spark, sf_dir, "conversations")
    told = conversations.repair_conversations(conversations.damage(rows)).withColumn("key", conversations.conv_key(F.col("conv_id"))).drop("conv_id")
    every = rows.select("conv_id").distinct().withColumn("key", conversations.conv_key(F.col("conv_id")))
    nothing = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.join(told, "key", "left").withColumns(nothing).drop("key")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes that they decode to, as digests. Edge cases as in `byte_bpe.encode_documents`."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_documents(encoded.select("doc_id", "ids"), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_toxicity, op3_media, op4_near_dedup, op5_language, op6_suffix_lm, op7_exact_dedup, op8_mixing, op9_warc, op10_packing, op11_spelling, op12_conversations, op13_byte_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
