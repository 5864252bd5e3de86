"""Baselines, metrics, champions, intervals and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.history import FEATURES, MEASURE, order_history, prior
from tidemark.demo.registry import Tables, query
from tidemark.operators import metrics, quality, reshape, windows
from tidemark.plans import evaluation, frozen, models
from tidemark.sources.shared import kept, shared_dir

MODELS = ["previous", "last3", "last5"]


def predictions(t: Tables) -> DataFrame:
    """Order history with three candidate predictions and the category mean of the training years, rounded alike in all engines."""
    df = windows.prior_features(order_history(t), prior(), [MEASURE])
    means = df.where("season <= 1999").groupBy("o_orderpriority").agg(F.round(F.avg(MEASURE), 6).alias("category_mean"))
    df = evaluation.baseline_chain(df, [f"{MEASURE}_last5", f"{MEASURE}_last3", f"{MEASURE}_prev"], means, ["o_orderpriority"], "category_mean")
    named = zip(MODELS, ("prev", "last3", "last5"), strict=True)
    return df.withColumns({m: F.round(F.coalesce(f"{MEASURE}_{c}", "category_mean"), 6) for m, c in named} | {"prediction": F.round("prediction", 6)})


PREDICTED = """h AS (SELECT *, year(o_orderdate)::INTEGER AS season FROM orders), f AS (SELECT *, lag(o_totalprice) OVER w AS p1, avg(o_totalprice) OVER w3 AS p3, avg(o_totalprice) OVER w5 AS p5 FROM h
  WINDOW w AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey), w3 AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
m AS (SELECT o_orderpriority AS cat, round(avg(o_totalprice), 6) AS cm FROM h WHERE season <= 1999 GROUP BY 1),
d AS (SELECT f.*, round(coalesce(p5, cm), 6) AS prediction, CASE WHEN p5 IS NOT NULL THEN 'o_totalprice_last5' WHEN cm IS NOT NULL THEN 'category_mean' ELSE 'none' END AS prediction_source,
  round(coalesce(p1, cm), 6) AS previous, round(coalesce(p3, cm), 6) AS last3, round(coalesce(p5, cm), 6) AS last5 FROM f LEFT JOIN m ON cat = o_orderpriority)"""
WEEKLY = f"""{PREDICTED}, u AS (UNPIVOT (SELECT o_orderkey, o_orderpriority, season, month(o_orderdate)::INTEGER AS period, o_totalprice, previous, last3, last5 FROM d WHERE season = 2000) ON previous, last3, last5 INTO NAME model VALUE p),
k AS (SELECT *, rank() OVER (PARTITION BY model, o_orderpriority, period ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY model, o_orderpriority, period, o_totalprice) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY model, o_orderpriority, period ORDER BY p) + (count(*) OVER (PARTITION BY model, o_orderpriority, period, p) - 1) / 2.0 AS rp,
  row_number() OVER (PARTITION BY model, o_orderpriority, period ORDER BY o_totalprice DESC, o_orderkey) AS ta, row_number() OVER (PARTITION BY model, o_orderpriority, period ORDER BY p DESC, o_orderkey) AS tp,
  least(10, count(*) OVER (PARTITION BY model, o_orderpriority, period)) AS cut FROM u WHERE p IS NOT NULL),
e AS (SELECT model, o_orderpriority, period, count(*) AS n_rows, avg(abs(p - o_totalprice)) AS mae, sqrt(avg((p - o_totalprice) * (p - o_totalprice))) AS rmse,
  CASE WHEN count(*) >= 2 AND min(o_totalprice) < max(o_totalprice) AND min(p) < max(p) THEN corr(ra, rp) END AS spearman, 100.0 * count(*) FILTER (ta <= cut AND tp <= cut) / max(cut) AS top_overlap FROM k GROUP BY 1, 2, 3)"""
VALUES = ["mae", "rmse", "spearman", "top_overlap"]


def weekly(t: Tables) -> DataFrame:
    df = predictions(t).where("season = 2000").withColumn("period", F.month("o_orderdate"))
    long = reshape.stacked(df, ["o_orderkey", "o_orderpriority", "period", MEASURE], MODELS, "model", "p")
    return metrics.metrics(long, ["model", "o_orderpriority", "period"], MEASURE, "p", ["o_orderkey"], 10)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in VALUES})


@query(f"WITH {PREDICTED} SELECT o_orderkey, prediction, prediction_source, CASE WHEN p5 IS NULL THEN 0 ELSE 1 END AS covered FROM d")
def baseline_chain(t: Tables) -> DataFrame:
    return predictions(t).select("o_orderkey", "prediction", "prediction_source", F.when(F.col(f"{MEASURE}_last5").isNull(), 0).otherwise(1).alias("covered"))


@query(f"WITH {WEEKLY} SELECT model, o_orderpriority, period, n_rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(spearman, 4) AS spearman, round(top_overlap::DOUBLE, 4) AS top_overlap FROM e")
def error_metrics_by_period(t: Tables) -> DataFrame:
    return shown(weekly(t))


SUMMARY = f"""{WEEKLY}, s AS (SELECT model, CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority, sum(n_rows)::BIGINT AS n_rows, avg(mae) AS mae, avg(rmse) AS rmse, avg(spearman) AS spearman,
  avg(top_overlap::DOUBLE) AS top_overlap FROM e GROUP BY GROUPING SETS ((model), (model, o_orderpriority)))"""


@query(f"WITH {SUMMARY} SELECT model, o_orderpriority, n_rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(spearman, 4) AS spearman, round(top_overlap, 4) AS top_overlap FROM s")
def metric_summary(t: Tables) -> DataFrame:
    return shown(metrics.summary(weekly(t), "model", "o_orderpriority", VALUES))


def chosen(t: Tables) -> DataFrame:
    scores = metrics.summary(weekly(t), "model", "o_orderpriority", VALUES).where("o_orderpriority <> 'ALL'")
    return evaluation.champions(scores, "previous", "o_orderpriority")


CHOSEN = f"""{SUMMARY}, b AS (SELECT o_orderpriority, mae AS bm, spearman AS bs, top_overlap AS bt FROM s WHERE model = 'previous' AND o_orderpriority <> 'ALL'),
x AS (SELECT s.o_orderpriority, model, mae, row_number() OVER (PARTITION BY s.o_orderpriority ORDER BY mae, rmse, model) AS r FROM s JOIN b ON s.o_orderpriority = b.o_orderpriority
  WHERE model <> 'previous' AND bm - mae >= 0 AND coalesce(bs - spearman, 0) <= 0.01 AND bt - top_overlap <= 2.0),
c AS (SELECT b.o_orderpriority, coalesce(model, 'previous') AS champion, coalesce(mae, bm) AS champion_mae, bm AS baseline_mae FROM b LEFT JOIN x ON x.o_orderpriority = b.o_orderpriority AND r = 1)"""


@query(f"WITH {CHOSEN} SELECT o_orderpriority, champion, round(champion_mae, 6) AS champion_mae, round(baseline_mae, 6) AS baseline_mae FROM c")
def champion_selection(t: Tables) -> DataFrame:
    return chosen(t).withColumns({c: F.round(c, 6) for c in ("champion_mae", "baseline_mae")})


@query(f"WITH {CHOSEN} SELECT o_orderkey, d.o_orderpriority, champion, CASE champion WHEN 'previous' THEN previous WHEN 'last3' THEN last3 ELSE last5 END AS composite FROM d JOIN c ON c.o_orderpriority = d.o_orderpriority WHERE season = 2001")
def composite_prediction(t: Tables) -> DataFrame:
    df = predictions(t).where("season = 2001")
    return evaluation.composite(df, chosen(t), "o_orderpriority", MODELS, "composite").select("o_orderkey", "o_orderpriority", "champion", "composite")


INTERVALS = f"{PREDICTED}, q AS (SELECT o_orderpriority AS cat2, quantile_cont(o_totalprice - prediction, 0.1) AS lo, quantile_cont(o_totalprice - prediction, 0.9) AS hi, count(o_totalprice - prediction) AS n FROM d WHERE season = 2000 GROUP BY 1), i AS (SELECT d.*, q.*, greatest(prediction + lo, 0.0) AS lower, greatest(prediction + hi, greatest(prediction + lo, 0.0)) AS upper FROM d LEFT JOIN q ON cat2 = o_orderpriority WHERE season = 2001)"


def intervals(t: Tables) -> DataFrame:
    df = predictions(t)
    quantiles = metrics.residual_quantiles(df.where("season = 2000"), ["o_orderpriority"], MEASURE, "prediction")
    return metrics.apply_intervals(df.where("season = 2001"), quantiles, ["o_orderpriority"], "prediction")


@query(f"WITH {INTERVALS} SELECT o_orderpriority, max(n) AS n_calibration, round(max(lo), 7) AS lower_residual, round(max(hi), 7) AS upper_residual, count(*) AS n_rows, round(100.0 * avg(CASE WHEN o_totalprice BETWEEN prediction + lo AND prediction + hi THEN 1 ELSE 0 END), 2)::DOUBLE AS coverage, round(avg(hi - lo), 7) AS width FROM i GROUP BY 1")
def residual_intervals(t: Tables) -> DataFrame:
    """Calibrated on one season; coverage and width of the raw interval on the next."""
    df = predictions(t)
    quantiles = metrics.residual_quantiles(df.where("season = 2000"), ["o_orderpriority"], MEASURE, "prediction")
    test = df.where("season = 2001").join(quantiles, "o_orderpriority", "left")
    found = metrics.interval_coverage(test, ["o_orderpriority"], MEASURE, "prediction").drop("mae").join(quantiles, "o_orderpriority")
    return found.withColumns({"coverage": F.round("coverage", 2)} | {c: F.round(c, 7) for c in ("width", "lower_residual", "upper_residual")})


@query(f"WITH {INTERVALS} SELECT o_orderkey, round(lower, 7) AS floor, round(upper, 7) AS ceiling FROM i")
def interval_apply(t: Tables) -> DataFrame:
    return intervals(t).select("o_orderkey", F.round("floor", 7).alias("floor"), F.round("ceiling", 7).alias("ceiling"))


NUMERIC = [FEATURES[0], FEATURES[1], FEATURES[2], FEATURES[4], "prior_rows"]
TEXT = ["o_orderstatus"]


def modelled(t: Tables) -> DataFrame:
    return windows.prior_features(order_history(t), prior(), [MEASURE]).withColumn("prior_rows", F.col("prior_rows").cast("double"))


def fitted(t: Tables, kind: str) -> DataFrame:
    """Fitted on the training years by category, predicting the validation year; rows in, predictions out."""
    df = modelled(t)
    train, later = df.where("season <= 1999"), df.where("season = 2000")
    train = train.select("o_orderkey", "o_orderpriority", MEASURE, *NUMERIC, *TEXT).persist()  # read by some six passes
    found = models.fit_trees(train, "o_orderpriority", NUMERIC, MEASURE, kind, TEXT)
    train.unpersist()
    return models.predict_trees(later, found).select("o_orderkey", "o_orderpriority", MEASURE, "prediction")


@query()
def ridge_by_category(t: Tables) -> DataFrame:
    """Ridge on numbers with indicators and one-hot texts, fitted on the training years, predicting the validation year."""
    df = modelled(t).select("o_orderkey", "o_orderpriority", "season", MEASURE, *NUMERIC, *TEXT).persist()  # read by both passes and the prediction
    found = models.fit_ridge(df.where("season <= 1999"), "o_orderpriority", NUMERIC, MEASURE, text=TEXT)
    return models.routed(df.where("season = 2000"), found, "o_orderpriority", NUMERIC, TEXT).select("o_orderkey", "o_orderpriority", MEASURE, "prediction")


LINE = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 'unseen' ELSE l_returnflag END AS category, l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem),
s AS (SELECT category, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS sxy, var_pop(x) AS sxx FROM c WHERE l_linestatus = 'F' AND category IN ('A', 'N', 'R') GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c.category, CASE WHEN s.category IS NULL THEN 'NO_MODEL' ELSE 'MODEL' END AS route, round(my + (x - mx) * n * sxy / (n * sxx + 10 * sxx), 3) AS prediction FROM c LEFT JOIN s ON s.category = c.category WHERE l_linestatus = 'O'"""


def routed_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines with a category that is null or unseen in some, and those of them to train on."""
    s = F.col("l_suppkey") % 10
    category = F.when(s == 0, F.lit(None).cast("string")).when(s == 1, "unseen").otherwise(F.col("l_returnflag"))
    df = t.lineitem.withColumn("category", category)
    return df, df.where("l_linestatus = 'F' and category <> 'unseen'").withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query(LINE)
def routed_inference(t: Tables) -> DataFrame:
    """Rows routed to the frozen model of their category; those of a null or unseen category are kept and say so."""
    df, train = routed_rows(t)
    found = models.fit_ridge(train, "category", ["l_quantity"], "l_extendedprice")
    out = models.routed(df.where("l_linestatus = 'O'"), found, "category", ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "category", "route", F.round("prediction", 3).alias("prediction"))


@query()
def forest_by_category(t: Tables) -> DataFrame:
    return fitted(t, "forest")


@query()
def boosting_by_category(t: Tables) -> DataFrame:
    return fitted(t, "boosting")


RIDGE = """r AS (SELECT {0} AS until, o_orderpriority AS cat3, count(*) AS n, avg(prediction) AS mx, avg(o_totalprice) AS my, covar_pop(prediction, o_totalprice) AS sxy, var_pop(prediction) AS sxx FROM d WHERE season <= {0} GROUP BY 2)"""
LINEAR = "round(my + (d.prediction - mx) * n * sxy / (n * sxx + 10 * sxx), 6)"
REFIT = f"""{WEEKLY.replace("UNPIVOT (SELECT o_orderkey, o_orderpriority, season, month(o_orderdate)::INTEGER AS period, o_totalprice, previous, last3, last5 FROM d WHERE season = 2000) ON previous, last3, last5",
  f"UNPIVOT (SELECT o_orderkey, o_orderpriority, season, month(o_orderdate)::INTEGER AS period, o_totalprice, previous, last3, last5, {LINEAR} AS ridge FROM d JOIN ({RIDGE.format(1999)[6:-1]}) r ON cat3 = o_orderpriority WHERE season = 2000) ON previous, last3, last5, ridge")}"""
REFIT = REFIT + SUMMARY[len(WEEKLY):] + CHOSEN[len(SUMMARY):]


@query(f"""WITH {REFIT}, {RIDGE.format(2000)}, z AS (SELECT d.o_orderpriority, champion, o_totalprice, previous, CASE champion WHEN 'previous' THEN previous WHEN 'last3' THEN last3 WHEN 'last5' THEN last5 ELSE {LINEAR} END AS p
  FROM d JOIN c ON c.o_orderpriority = d.o_orderpriority JOIN r ON cat3 = d.o_orderpriority WHERE season = 2001)
SELECT o_orderpriority, champion, count(*) AS n_rows, round(avg(abs(p - o_totalprice)), 3) AS champion_mae, round(avg(abs(previous - o_totalprice)), 3) AS baseline_mae FROM z GROUP BY 1, 2""")
def champion_refit(t: Tables) -> DataFrame:
    """Ridge beside three moving averages: fitted on the training years, chosen by guard on the validation year, the chosen refitted
    on both, the test year predicted once."""
    df = kept(predictions(t).withColumnRenamed("prediction", "x").withColumn("period", F.month("o_orderdate")))
    years = [df.where(f"season {x}") for x in ("<= 1999", "= 2000", "= 2001")]

    def ridge(train: DataFrame):
        found = models.fit_ridge(train, "o_orderpriority", ["x"], MEASURE)
        return lambda rows: models.routed(rows, found, "o_orderpriority", ["x"]).drop("route")

    _, chosen, out = evaluation.choose_and_refit(*years, "o_orderpriority", MEASURE, ["o_orderkey"], "period", MODELS, "previous", {"ridge": ridge})
    error = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col(MEASURE))), 3)
    return out.groupBy("o_orderpriority", "champion").agg(F.count("*").alias("n_rows"), error("prediction").alias("champion_mae"), error("previous").alias("baseline_mae"))


@query()
def fitted_champions(t: Tables) -> DataFrame:
    """The same way with ridge, forests and boosting (of 100 trees and rounds) on all features: scores of every candidate per
    category and over all on the validation year, and where it was chosen, the champion's error on the test year."""
    df = windows.prior_features(order_history(t), prior(), [MEASURE]).withColumn("prior_rows", F.col("prior_rows").cast("double"))
    named = zip(MODELS, ("prev", "last3", "last5"), strict=True)
    own = df.where("season <= 1999").groupBy("o_orderpriority").agg(F.avg(MEASURE).alias("_mean"))
    df = df.join(own, "o_orderpriority", "left").withColumns({m: F.coalesce(f"{MEASURE}_{c}", "_mean") for m, c in named})
    df = kept(df.select("o_orderkey", "o_orderpriority", "season", F.month("o_orderdate").alias("period"), MEASURE, *MODELS, *NUMERIC, *TEXT))

    def ridge(train: DataFrame):
        found = models.fit_ridge(train, "o_orderpriority", NUMERIC, MEASURE, text=TEXT)
        return lambda rows: models.routed(rows, found, "o_orderpriority", NUMERIC, TEXT).drop("route")

    def trees(kind: str, **size):
        def fit(train: DataFrame):
            model = models.fit_trees(train, "o_orderpriority", NUMERIC, MEASURE, kind, TEXT, **size)
            return lambda rows: models.predict_trees(rows, model)

        return fit

    fitters = {"ridge": ridge, "forest": trees("forest", trees=100), "boosting": trees("boosting", rounds=100)}
    years = [df.where(f"season {x}") for x in ("<= 1999", "= 2000", "= 2001")]
    scores, chosen, out = evaluation.choose_and_refit(*years, "o_orderpriority", MEASURE, ["o_orderkey"], "period", MODELS, "previous", fitters)
    tested = out.groupBy("o_orderpriority", F.col("champion").alias("model")).agg(F.avg(F.abs(F.col("prediction") - F.col(MEASURE))).alias("test_mae"))
    return scores.join(tested, ["o_orderpriority", "model"], "left").select("model", "o_orderpriority", "n_rows", *VALUES, "test_mae")


@query(LINE[: LINE.rindex("SELECT l_orderkey")] + """SELECT coalesce(category, 'ALL') AS category, count(*) AS n_rows, 0::BIGINT AS n_missing, 0::BIGINT AS n_mismatch, 0.0::DOUBLE AS max_difference, round(avg(p), 2) AS mean_prediction, 'PASS' AS status
FROM (SELECT c.category, my + (x - mx) * n * sxy / (n * sxx + 10 * sxx) AS p FROM c JOIN s ON s.category = c.category WHERE l_linestatus = 'O') GROUP BY GROUPING SETS ((category), ())""")
def frozen_model_parity(t: Tables) -> DataFrame:
    """A ridge model frozen as a table and read back (refused if its rows changed) predicts what the fresh one does, per category and
    over all; the mean prediction shows that it is the model in SQL."""
    df, train = routed_rows(t)
    found = models.fit_ridge(train, "category", ["l_quantity"], "l_extendedprice")
    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    frozen.freeze(found, path)
    keyed = df.where("l_linestatus = 'O'").withColumn("row", F.monotonically_increasing_id())
    keyed = kept(keyed.select("row", "category", "l_quantity"))
    told = lambda m: models.routed(keyed, m, "category", ["l_quantity"]).where("route = 'MODEL'").select("row", "category", "prediction")
    again = told(frozen.thaw(t.spark, path))
    same = quality.parity(told(found), again, ["row"], "category", "prediction", 1e-9).drop("mean_difference")
    means = again.rollup("category").agg(F.grouping("category").alias("_all"), F.round(F.avg("prediction"), 2).alias("mean_prediction"))
    means = means.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category")).alias("category"), "mean_prediction")
    return same.join(means, "category").withColumn("max_difference", F.round("max_difference", 6))
