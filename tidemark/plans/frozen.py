"""Fitted models as stored tables: written as versions (`sources.snapshots`), refused when the rows that come back aren't those
that were frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.models import TreeModel
from tidemark.plans.trees import Fitted
from tidemark.sources import snapshots
from tidemark.sources.tables import fingerprint

ROWS = "kind string, name string, k long, ints array<int>, numbers array<double>, texts array<string>"


def freeze(models: DataFrame, path: str) -> dict | None:
    """Store a table of models; None if the newest stored version has the same rows."""
    return snapshots.publish(models, path)


def thaw(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The stored table, checked against the fingerprint taken when it was frozen; ValueError where it differs."""
    entry = snapshots.current(spark, path) if number is None else None
    df = snapshots.read(spark, path, number)
    wanted = entry or next(dict(e, number=n) for n, e in snapshots._Store(spark, path).pointers() if n == number)
    have = {k: str(v) for k, v in fingerprint(df).first().asDict().items()}
    if have != wanted["fingerprint"]:
        raise ValueError(f"{path}: version {wanted['number']} isn't what was frozen ({have} for {wanted['fingerprint']})")
    return df


def trees_table(spark: SparkSession, model: TreeModel) -> DataFrame:
    """A tree model as rows: nodes by group of trees, roots and edges by category, and what fills gaps; trees that are a table stay one,
    and don't pass through the driver."""
    f, rows = model.fitted, []
    for g, (feature, cut, left, right, value, roots) in enumerate(f.tables):
        rows.append(("nodes", "", g, [int(x) for part in (feature, cut, left, right) for x in part], [float(x) for x in value], None))
        rows += [("roots", str(g), code, [int(r) for r in own], None, None) for code, own in roots.items()]
    for code, (category, base) in enumerate(zip(f.categories, f.base, strict=True)):
        rows.append(("category", str(category), code, None, [float(base)], None))
        rows += [("edges", str(code), i, None, [float(x) for x in own], None) for i, own in enumerate(f.edges[code])]
    rows += [("levels", c, i, None, None, list(v)) for i, (c, v) in enumerate(model.by_text.items())]
    rows += [("gaps", str(r[model.category]), 0, None, list(r["medians"]), list(r["modes"])) for r in model.learnt.collect()]  # one a category
    rows.append(("about", model.category, 0, None, [f.factor], [model.learnt.schema[model.category].dataType.simpleString(), *model.numeric]))
    table = spark.createDataFrame(rows, ROWS)
    if f.grown is None:
        return table
    made = F.array(F.col("number").cast("string"), F.base64("made"))
    return table.unionByName(f.grown.select(F.lit("grown").alias("kind"), F.col("part").cast("string").alias("name"), F.col("code").cast("long").alias("k"), F.array(F.lit(f.parts)).alias("ints"), F.lit(None).cast("array<double>").alias("numbers"), made.alias("texts")))


def trees_from(df: DataFrame) -> TreeModel:
    """The model of `trees_table`'s rows, which are bounded by trees.MOST_NODES but for trees that are a table."""
    import numpy as np

    by: dict[str, list] = {}
    for r in df.where("kind <> 'grown'").orderBy("kind", "name", "k").collect():
        by.setdefault(r["kind"], []).append(r)
    about = by["about"][0]
    kind, *numeric = about["texts"]
    category, spark = about["name"], df.sparkSession
    gaps = spark.createDataFrame([(r["name"], r["numbers"], r["texts"]) for r in by.get("gaps", [])], "name string, medians array<double>, modes array<string>")
    learnt = gaps.select(F.col("name").cast(kind).alias(category), "medians", "modes")
    known = sorted(by.get("category", []), key=lambda r: r["k"])
    values = spark.createDataFrame([(r["k"], r["name"]) for r in known], "k long, name string").select("k", F.col("name").cast(kind).alias("v")).orderBy("k").collect()
    edges: dict = {r["k"]: [] for r in known}
    for r in sorted(by.get("edges", []), key=lambda r: (int(r["name"]), r["k"])):
        edges[int(r["name"])].append(np.array(r["numbers"]))
    tables = []
    for r in sorted(by.get("nodes", []), key=lambda r: r["k"]):
        parts = np.array(r["ints"], np.int32).reshape(4, -1)
        tables.append((*parts, np.array(r["numbers"]), {x["k"]: x["ints"] for x in by["roots"] if x["name"] == str(r["k"])}))
    levels = {r["name"]: r["texts"] for r in sorted(by.get("levels", []), key=lambda r: r["k"])}
    own = df.where("kind = 'grown'")
    parts = own.select(F.col("ints")[0]).first()
    grown = own.select(F.col("k").cast("int").alias("code"), F.col("name").cast("int").alias("part"), F.col("texts")[0].cast("int").alias("number"), F.unbase64(F.col("texts")[1]).alias("made")) if parts else None
    fitted = Fitted([v["v"] for v in values], edges, tables, [r["numbers"][0] for r in known], about["numbers"][0], grown, parts[0] if parts else 1)
    return TreeModel(fitted, learnt, levels, category, numeric)
