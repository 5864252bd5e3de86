"""Language identification by nearest centroid of TF-IDF vectors over n-grams of UTF-8 bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_chunks

#: Labelled texts per language that the model is fitted on, at most; languages that it may have; terms of the vocabulary;
#: centroids a language.
SAMPLE, LANGUAGES, TERMS, CENTROIDS = 600, 1000, 2048, 3
#: Parts of a language's rows whose first texts (by hash) are found apart from each other.
PARTS = 64
#: A text further from its nearest centroid than this quantile of the training distances, plus a margin, is rejected.
REJECT_AT, MARGIN = 0.999, 0.05
LETTER = re.compile(r"[^\W\d_]")


def _grams(text: bytes):
    """Codes of the byte trigrams of a text as one number each; a space stands on either side."""
    import numpy as np

    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def _lower(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode("utf-8", "replace")


def fit_centroids(texts: list[bytes], langs: list[str], terms: int = TERMS, centroids: int = CENTROIDS) -> dict:
    """Vocabulary, IDF, centroids by spherical k-means within each language, and the distance at which to reject."""
    import numpy as np

    if not texts:
        return {"langs": [], "lookup": None}
    own = [np.unique(_grams(_lower(x)), return_counts=True) for x in texts]
    seen, df = np.unique(np.concatenate([g for g, _ in own]), return_counts=True)
    top = np.sort(seen[np.lexsort((seen, -df))[:terms]])
    idf = np.log((1 + len(texts)) / (1 + df[np.searchsorted(seen, top)])) + 1
    rows = np.zeros((len(texts), len(top)), np.float32)
    for i, (g, n) in enumerate(own):
        at = np.searchsorted(top, g).clip(max=len(top) - 1)
        hit = top[at] == g
        rows[i, at[hit]] = n[hit]
    rows = _unit(rows * idf.astype(np.float32))
    labels, names, means, spread = np.array(langs), [], [], []
    for name in sorted(set(langs)):
        x = rows[labels == name]
        k = min(centroids, len(x))
        at = [0]
        for _ in range(1, k):  # farthest points first, so that reruns agree
            at.append(int((x @ x[at].T).max(1).argmin()))
        c = x[at]
        for _ in range(12):
            near = (x @ c.T).argmax(1)
            c = _unit(np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)]))
        spread.append(1 - (x @ c.T).max(1))
        means.append(c)
        names += [name] * k
    limit = float(np.quantile(np.concatenate(spread), REJECT_AT)) + MARGIN
    return {"langs": names, "terms": top, "idf": idf.astype(np.float32), "centroids": np.vstack(means), "limit": limit}


def _unit(rows):
    import numpy as np

    return rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)


def predict_language(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, lang_pred, score (cosine to the nearest centroid, 0 to 1), distance, rejected (further than the
    model's limit: unlike any language it knows, though lang_pred still names the nearest).

    Edge cases: null text and texts without a letter are `und` with score 0, as is every text when the model
    knows no language; a text with none of the model's n-grams gets the first language with score 0, rejected; a very
    long text is read whole; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        names = model["langs"]
        if names:
            lookup = np.full(1 << 24, -1, np.int16)
            lookup[model["terms"]] = np.arange(len(model["terms"]), dtype=np.int16)
        for part, texts in text_chunks(batches, "text", 1 << 20):
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            have = [i for i, x in enumerate(texts) if names and LETTER.search(x.decode("utf-8", "replace"))]
            for k in range(0, len(have), 512):
                some = have[k : k + 512]
                rows = np.zeros((len(some), len(model["terms"])), np.float32)
                for j, i in enumerate(some):
                    ids = lookup[_grams(_lower(texts[i]))]
                    rows[j] = np.bincount(ids[ids >= 0], minlength=rows.shape[1])
                near = _unit(rows * model["idf"]) @ model["centroids"].T
                best = near.argmax(1)
                for j, i in enumerate(some):
                    lang[i], score[i] = names[best[j]], min(1.0, max(0.0, float(near[j, best[j]])))
            told = np.array([x != "und" for x in lang], bool)
            rejected = ~told | (1 - score > model.get("limit", 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lang), pa.array(score), pa.array(1 - score), pa.array(rejected)],
                ["id", "lang_pred", "score", "distance", "rejected"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, distance double, rejected boolean"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def train_language_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` texts of each language among the rows where `train` holds and the language is known, in the
    order of a hash of id and text. Rows are ranked by that hash only, a language in PARTS parts; then the sample's
    texts are fetched by id and hash.

    Edge cases: rows with a null id, text or language, or a null condition, train nothing; rows that repeat an id are told
    apart by their texts, and equal rows count once; more than LANGUAGES languages raise ValueError; an empty table gives
    a model that knows no language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), train.alias("train"))
    rows = rows.where("train and lang is not null and text is not null and id is not null").withColumn("h", F.xxhash64("id", "text"))
    names = rows.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(names) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    # a hash threshold with a wide margin leaves some multiple of the sample; only where it leaves too few do all rows count
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = {name: min(1.0, 4.0 * sample / n) for name, n in sizes.items()}
    share = F.pmod(F.col("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    below = F.lit(False)
    for name, most in keep.items():
        below = below | ((F.col("lang") == name) & (share < most))
    few = rows.where(below).select("lang", "h", "id", F.pmod(F.col("h"), F.lit(PARTS)).alias("part"))
    inside = Window.partitionBy("lang", "part").orderBy("h", "id")
    few = few.distinct().withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= sample)
    # at most PARTS * `sample` rows of a language are left, whose first `sample` one job finds for all languages
    first = Window.partitionBy("lang").orderBy("h", "id")
    ids = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select("id", "h").collect()
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["h"]) for r in ids], f"id {rows.schema['id'].dataType.simpleString()}, h long")
    got = rows.join(F.broadcast(chosen), ["id", "h"]).select("id", "text", "lang").distinct().collect()  # `sample` a language
    got = sorted({(str(r["id"]), r["lang"], r["text"]) for r in got})
    return fit_centroids([t.encode("utf-8", "replace") for _, _, t in got], [x for _, x, _ in got])
