"""Every demonstration query that SQL can express, against DuckDB on the smallest driver tables."""

import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import demo

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(demo.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = demo.queries()[name](spark, DATA)
    answer = duck.execute(demo.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=key)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in answer.fetchall()), key=key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(x, (int, float)) for x in a) else all(
            x == pytest.approx(y, abs=2e-4) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)
        )


def test_ridge_equals_the_closed_form(spark):
    import numpy as np

    from tidemark.plans import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=200)
    df = spark.createDataFrame([("c", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "g string, a double, b double, y double")
    df = df.unionByName(spark.createDataFrame([("c", None, 1.0, None), (None, 1.0, 1.0, 5.0)], df.schema))
    fitted = models.fit_ridge(df, "g", ["a", "b"], "y", alpha=10.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    got = models.routed(df, fitted, "g", ["a", "b"]).collect()
    assert np.allclose([r.prediction for r in got if r.y is not None and r.g], z @ beta + y.mean(), atol=1e-6)
    assert [r.route for r in got if r.g is None] == ["NO_MODEL"] and sum(r.route == "MODEL" for r in got) == 201


def test_ridge_with_texts_and_missing_values(spark):
    import numpy as np

    from tidemark.plans import models

    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["p", "q"])), None if k % 9 == 0 else float(rng.normal()), None if k % 11 == 0 else str(rng.choice(["u", "v", "w"])), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, a double, s string, y double")
    found = models.fit_ridge(df, "g", ["a"], "y", alpha=3.0, text=["s"])
    got = models.routed(df, found, "g", ["a"], ["s"]).collect()
    for g in ("p", "q"):
        own = [r for r in rows if r[0] == g]
        known = [r[1] for r in own if r[1] is not None]
        texts = [r[2] for r in own if r[2]]
        mode = max(sorted(set(texts)), key=lambda v: (texts.count(v), v))
        mode = next(r.modes[0] for r in found.collect() if r.g == g) if texts.count(mode) == max(map(texts.count, set(texts))) else mode
        x = np.array([[np.median(known) if r[1] is None else r[1], float(r[1] is None), *[float((r[2] or mode) == v) for v in "uvw"]] for r in own])
        y = np.array([r[3] for r in own])
        z = (x - x.mean(0)) / x.std(0)
        want = z @ np.linalg.solve(z.T @ z + 3 * np.eye(5), z.T @ (y - y.mean())) + y.mean()
        assert np.allclose(sorted(r.prediction for r in got if r.g == g), sorted(want), atol=1e-6)
    assert models.fit_ridge(df.limit(0), "g", ["a"], "y").count() == 0


def test_forest_and_boosting_have_the_published_size():
    import inspect

    from tidemark.plans import trees

    size = lambda f: {k: v.default for k, v in inspect.signature(f).parameters.items() if v.default is not v.empty}
    boosting, forest = size(trees.fit_boosting), size(trees.fit_forest)
    assert [boosting[k] for k in ("rounds", "rate", "leaves", "least")] == [300, 0.05, 31, 20]
    assert [forest[k] for k in ("trees", "least", "share")] == [300, 5, 0.7]


def tree_rows(n=500, seed=2):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return [("c" if k % 2 else "d", float(a), float(b) if k % 9 else None, "xy"[k % 2], float(a * b + k % 2 + rng.normal() / 5)) for k, (a, b) in enumerate(x)]


def test_one_boosted_tree_against_plain_growth(spark):
    """Best gain first, by trying every cut of every leaf."""
    import numpy as np

    from tidemark.plans import trees

    rows = [r for r in tree_rows(240) if r[2] is not None]
    df = spark.createDataFrame(rows, "g string, a double, b double, s string, y double")
    for l2 in (0.0, 3.0):
        got = trees.fit_boosting(df, "g", ["c", "d"], [F.col("a"), F.col("b")], "y", rounds=1, rate=1.0, leaves=6, least=8, l2=l2)
        for code, g in enumerate("cd"):
            own = [r for r in rows if r[0] == g]
            x, y = np.array([r[1:3] for r in own]), np.array([r[4] for r in own])
            left = y - y.mean()
            leaves = [np.arange(len(own))]
            score = lambda i, t=left: t[i].sum() ** 2 / (len(i) + l2)
            while len(leaves) < 6:
                tries = [
                    (score(i[x[i, f] <= c]) + score(i[x[i, f] > c]) - score(i), k, i[x[i, f] <= c], i[x[i, f] > c])
                    for k, i in enumerate(leaves) for f in (0, 1) for c in x[i, f] if min((x[i, f] <= c).sum(), (x[i, f] > c).sum()) >= 8
                ]
                if not tries:
                    break
                _, k, one, two = max(tries, key=lambda t: t[0])
                leaves[k : k + 1] = [one, two]
            want = np.empty(len(own))
            for i in leaves:
                want[i] = y.mean() + left[i].sum() / (len(i) + l2)
            assert np.allclose(got.predict(np.full(len(own), code), x), want)


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_trees_are_the_same_in_a_task_and_over_many(spark, kind):
    from tidemark.plans import models

    df = spark.createDataFrame(tree_rows(300), "g string, a double, b double, s string, y double").repartition(3)
    size = {"rounds": 4} if kind == "boosting" else {"trees": 5, "group": 2}
    found = []
    for block in (50_000, 60):
        model = models.fit_trees(df, "g", ["a", "b"], "y", kind, ["s"], block=block, **size)
        found.append({(r.g, r.a): r.prediction for r in models.predict_trees(df, model).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(v - found[1][k]) < 1e-9 for k, v in found[0].items())


@pytest.mark.parametrize("together", [1, 40, 4096])
def test_a_forests_tree_against_plain_growth(monkeypatch, together):
    """Large nodes by cells, small ones by sorted rows, and both in one tree: every split is the best of all cuts."""
    import numpy as np

    from tidemark.plans import growth

    monkeypatch.setattr(growth, "TOGETHER", together)
    r = np.random.default_rng(5)
    n, least = 300, 4
    bins = np.column_stack([r.integers(0, 200, n), r.integers(0, 9, n), r.random(n) < 0.3, np.full(n, 7), r.integers(0, 2, n) * 90]).astype(np.uint8)
    y, weight = r.normal(1e5, 1e4, n) + 3e4 * bins[:, 2] + 100 * bins[:, 0], r.poisson(1, n).astype(float)
    want = np.full(n, np.nan)

    def grow(own):
        w, t = weight[own], y[own]
        score = lambda k: (w[k] * t[k]).sum() ** 2 / w[k].sum()
        tries = [(score(k) + score(~k), k) for f in range(5) for c in range(256) for k in [bins[own, f] <= c] if min(w[k].sum(), w[~k].sum()) >= least] if w.sum() >= 2 * least else []
        if not tries:
            want[own] = (w * t).sum() / w.sum()
            return
        _, k = max(tries, key=lambda x: x[0])
        grow(own[k]), grow(own[~k])

    grow(np.flatnonzero(weight > 0))
    feature, cut, left, right, value = growth.unpacked(growth.Growing(growth.Rows(bins), weight, y, 1, least, 1.0, 42).packed())
    got = []
    for row in bins:
        node = 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] <= cut[node] else right[node]
        got.append(value[node])
    known = weight > 0
    assert np.allclose(np.array(got)[known], want[known]) and (feature >= 0).sum() > 20


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_categories_of_more_than_a_block_need_no_job_for_every_level(spark, kind):
    from tidemark.plans import trees

    df = spark.range(120_000).selectExpr("if(id % 2 = 0, 'c', 'd') g", "pmod(hash(id), 1000) / 7.0 a", "pmod(hash(id, 1), 50) * 1.0 b").withColumn("y", F.col("a") * F.col("b"))
    size = {"rounds": 4} if kind == "boosting" else {"trees": 4, "group": 2}
    fit = trees.fit_boosting if kind == "boosting" else trees.fit_forest
    spark.sparkContext.setJobGroup(f"fit-{kind}", "")
    try:
        fitted = fit(df, "g", ["c", "d"], [F.col("a"), F.col("b")], "y", **size)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{kind}")) <= 12
    error = F.avg(F.abs(F.col("prediction") - F.col("y")))
    out = trees.predict(df, fitted, "g", [F.col("a"), F.col("b")])
    assert out.count() == 120_000 and out.agg(error).first()[0] < (300 if kind == "forest" else 1800)


def test_forests_of_more_nodes_than_the_driver_may_hold(spark, monkeypatch):
    """A forest is a table: rows of several salts, of a null and of an unknown category, and the sums' order."""
    from tidemark.plans import models, trees

    df = spark.createDataFrame(tree_rows(400), "g string, a double, b double, s string, y double")
    model = models.fit_trees(df.where("g = 'c' or a < 0"), "g", ["a", "b"], "y", "forest", ["s"], trees=5, group=2)
    assert model.fitted.tables == [] and model.fitted.grown.count() == 10
    more = df.unionByName(df.selectExpr("if(a > 0, 'new', null) g", "a", "b", "s", "y"))
    told = lambda: sorted((str(r.g), r.a, str(r.b), r.prediction or 0.0) for r in models.predict_trees(more, model).collect())
    one = told()
    monkeypatch.setattr(trees, "HELD", 100)
    assert told() == one and len(one) == 800 and sum(x[3] == 0 for x in one) == 400


def test_quantiles_broadcast_no_rows(spark):
    from tidemark.operators.selection import quantiles

    df = spark.range(300).selectExpr("concat('c', id % 2) g", "id * 1.0 a", "id * 2.0 b").checkpoint()
    found = quantiles(df, ["g"], {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert {(r.g, r.a, r.b) for r in found.collect()} == {("c0", 149.0, 298.0), ("c1", 150.0, 300.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Inner, BuildLeft" not in plan and "LeftOuter" in plan


def test_scores_broadcast_no_ranks_and_are_made_once(spark):
    from tidemark.operators import metrics
    from tidemark.plans import evaluation

    df = spark.range(400).selectExpr("id", "concat('c', id % 2) g", "int(id % 3) period", "pmod(hash(id), 977) * 1.0 y", "pmod(hash(id, 1), 991) * 1.0 base")
    found = metrics.metrics(df, ["g"], "y", "base", ["id"], 5)
    assert found.count() == 2 and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") >= 2
    scores, chosen, _ = evaluation.choose_and_refit(df, df, df, "g", "y", ["id"], "period", ["base"], "base", {})
    assert scores.count() == 3 and chosen.count() == 2
    assert "Aggregate" not in scores._jdf.queryExecution().executedPlan().toString()


def test_boosting_errs_no_more_than_the_library_with_as_many_rounds(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tidemark.plans import models

    df = spark.createDataFrame([r for r in tree_rows(600, 7) if r[2] is not None and r[0] == "c"], "g string, a double, b double, s string, y double")
    train, later = df.where("pmod(hash(a), 3) > 0"), df.where("pmod(hash(a), 3) = 0")
    error = lambda out: out.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    ours = error(models.predict_trees(later, models.fit_trees(train, "g", ["a", "b"], "y", "boosting", rounds=25, rate=0.1)))
    put = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform
    theirs = error(GBTRegressor(featuresCol="features", labelCol="y", maxIter=25, stepSize=0.1, maxDepth=5, minInstancesPerNode=20, maxBins=255, seed=1).fit(put(train)).transform(put(later)))
    assert ours <= theirs * 1.02


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_fitted_trees_beat_the_mean(spark, kind):
    import numpy as np

    from tidemark.plans import models

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    rows = [("c" if k % 2 else "d", float(a), float(b), "xy"[k % 2], float(a * b + k % 2)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, "x", 0.0)], "g string, a double, b double, s string, y double")
    size = {"rounds": 60, "rate": 0.1} if kind == "boosting" else {"trees": 20}
    model = models.fit_trees(df.where("a < 1"), "g", ["a", "b"], "y", kind, ["s"], **size)
    got = models.predict_trees(df, model).select("g", "y", "prediction").collect()
    assert len(got) == 501 and [r.prediction for r in got if r.g is None] == [None]
    known = [r for r in got if r.g]
    mean = np.mean([r.y for r in known])
    assert np.mean([abs(r.prediction - r.y) for r in known]) < 0.75 * np.mean([abs(mean - r.y) for r in known])


def test_exact_quantiles_of_large_groups(spark):
    """With a coarse sketch, so that ranges are narrower than the groups; ties, nulls, null keys and nothing."""
    import random
    import statistics

    from tidemark.operators.selection import quantiles

    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.choice([None, 1.0, 1.0, r.gauss(0, 5), r.random() * 1e6]), float(k)) for k in range(3000)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {x.g: x for x in quantiles(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, [0.1, 0.5, 0.999], accuracy=50).collect()}

    def exact(values, p):
        values, at = sorted(values), (len(values) - 1) * p
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    for g in ("a", "b", None):
        for i, p in enumerate((0.1, 0.5, 0.999)):
            assert abs(got[g][f"v_{i}"] - exact([x[1] for x in rows if x[0] == g and x[1] is not None], p)) < 1e-6
            assert abs(got[g][f"w_{i}"] - exact([x[2] for x in rows if x[0] == g], p)) < 1e-6
    assert got["none"].v_1 is None and len(got) == 4
    assert quantiles(df.limit(0), ["g"], {"v": F.col("v")}, [0.5]).count() == 0
    median = quantiles(df.where("v is not null"), ["g"], {"v": F.col("v")}, [0.5]).where("g = 'b'").first().v
    assert abs(median - statistics.median([x[1] for x in rows if x[0] == "b" and x[1] is not None])) < 1e-6


def test_frozen_models_come_back_or_are_refused(spark, folder):
    import glob

    from tidemark.plans import frozen, models

    df = spark.createDataFrame(tree_rows(300), "g string, a double, b double, s string, y double")
    for kind, size in (("forest", {"trees": 4}), ("boosting", {"rounds": 5})):
        model = models.fit_trees(df, "g", ["a", "b"], "y", kind, ["s"], **size)
        frozen.freeze(frozen.trees_table(spark, model), f"{folder}/{kind}")
        again = frozen.trees_from(frozen.thaw(spark, f"{folder}/{kind}"))
        told = lambda m: sorted((str(r.g), r.a, r.prediction) for r in models.predict_trees(df, m).collect())  # noqa: E731, B023
        assert told(model) == told(again) and again.fitted.categories == ["c", "d"]
    ridge = models.fit_ridge(df, "g", ["a", "b"], "y", text=["s"])
    assert frozen.freeze(ridge, f"{folder}/ridge")["number"] == 1 and frozen.freeze(ridge, f"{folder}/ridge") is None
    assert sorted(map(str, frozen.thaw(spark, f"{folder}/ridge", 1).collect())) == sorted(map(str, ridge.collect()))
    place = glob.glob(f"{folder}/ridge/versions/*")[0]
    ridge.withColumn("intercept", F.col("intercept") + 1).write.mode("overwrite").parquet(place)
    with pytest.raises(ValueError, match="isn't what was frozen"):
        frozen.thaw(spark, f"{folder}/ridge")


def test_champions_are_chosen_on_one_year_and_tested_on_the_next(spark):
    """A candidate that knows the answer is chosen and refitted on both years; one that never gains isn't fitted again."""
    from tidemark.plans import evaluation

    rows = [(k, "ab"[k % 2], 1 + k // 40, k % 3, float(k % 17), float((k * 7) % 17)) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, year int, period int, y double, base double")
    fitted = []

    def fitter(name, column):
        def fit(train):
            fitted.append((name, sorted(r[0] for r in train.select("year").distinct().collect())))
            return lambda x: x.withColumn("prediction", column)

        return fit

    years = [df.where(F.col("year") == k) for k in (1, 2, 3)]
    scores, chosen, out = evaluation.choose_and_refit(*years, "g", "y", ["id"], "period", ["base"], "base", {"good": fitter("good", F.col("y") + 0.25), "bad": fitter("bad", -F.col("y") * 9)}, top=3)
    assert {r.champion for r in chosen.collect()} == {"good"} and {r.model for r in scores.collect()} == {"good", "bad", "base"}
    assert fitted == [("good", [1]), ("bad", [1]), ("good", [1, 2])]
    assert out.count() == 40 and all(r.prediction == r.y + 0.25 and r.year == 3 for r in out.collect())


def test_event_consistency_moves_lines_once_and_holds_on_odd_rows(spark, folder):
    """Repeated and null keys, lines without orders or suppliers, two orders and two customers of one key: as in SQL."""
    import random
    import re

    from tidemark import demo

    r = random.Random(4)
    some = lambda *v: "NULL" if (x := r.choice(v)) is None else x
    day = lambda: f"TIMESTAMP '1999-01-{r.randrange(1, 28):02d}'"
    made = {
        "lineitem(l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_discount DOUBLE, l_shipdate TIMESTAMP)": [
            (some(*range(30), None), some(1, 2, None), some(*range(6), None), some(1, 1, 2, None), r.randrange(1, 999) / 7, r.random() / 9, some(day(), day(), None)) for _ in range(600)],
        "orders(o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP)": [(some(*range(25), None), some(*range(9), None), day()) for _ in range(30)],
        "customer(c_custkey BIGINT, c_nationkey INT)": [(some(*range(8), None), some(0, 1, 2, 3, None)) for _ in range(12)],
        "supplier(s_suppkey BIGINT, s_nationkey INT)": [(some(*range(5), None), some(0, 1, 2, None)) for _ in range(7)],
        "nation(n_nationkey INT)": [(0,), (1,), (1,)],
    }
    db = duckdb.connect()
    for table, rows in made.items():
        name = table.split("(")[0]
        db.execute(f"CREATE TABLE {table}")
        db.execute(f"INSERT INTO {name} VALUES {', '.join('(' + ', '.join(map(str, x)) + ')' for x in rows)}")
        db.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    want = {x[0]: x[2] for x in db.execute(demo.oracle_sql()["event_consistency"]).fetchall()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for k in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", k)
            out = demo.queries()["event_consistency"](spark, folder)
            assert {x.check_name: x.actual for x in out.collect()} == want and sum(v > 0 for v in want.values()) >= 6
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ReadSchema: struct<l_orderkey") == 1 and not re.search(r"hashpartitioning\(l_orderkey#\d+L, l_linenumber", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
