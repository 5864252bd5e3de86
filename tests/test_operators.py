"""Single operators on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import facts, identity, joins, metrics, quality, ranking, reshape, windows
from tidemark.sources import tables
from tidemark.streaming.latest import latest_stream


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_prior_window_never_sees_its_row(spark):
    df = spark.createDataFrame([(2030, 3, "a", 1.5), (2030, 7, "a", 6.5), (2031, 2, "a", 9.0), (2031, 5, "a", 3.0)], "season int, week int, k string, v double")
    out = windows.prior_features(df, windows.Prior(["k"], ["season", "week"], "season"), ["v"]).orderBy("season", "week")
    got = [(r.v_prev, r.v_last3, r.v_season, r.prior_rows, r.prior_season_rows) for r in out.collect()]
    assert got == [(None, None, None, 0, 0), (1.5, 1.5, 1.5, 1, 1), (6.5, 4.0, None, 2, 0), (9.0, 17 / 3, 9.0, 3, 1)]


def test_bands_and_scores(spark):
    bands = [(2.5, 9), (100, 7), (None, -1)]
    df = spark.createDataFrame([(float(x),) for x in (-8, 2.5, 2.6, 100, 100.1)] + [(None,)], "v double")
    assert [r[0] for r in df.select(S.band_score("v", bands)).collect()] == [9, 9, 7, 7, -1, None]
    one = spark.createDataFrame([(2, None)], "a int, b int").select(S.linear_score({"a": 1.5, "b": 9}), S.floor_at(F.lit(-7.25)), S.ratio(F.lit(1), F.lit(0)))
    assert tuple(one.first()) == (3.0, 0.0, None)


def test_cleaning(spark):
    df = spark.createDataFrame([(" x ",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(S.clean("s")).collect()] == ["x", None, None]
    assert [r[0] for r in df.select(S.available("s")).collect()] == [True, False, False]
    words = spark.createDataFrame([(" True",), ("no",)], "s string").select(S.strict_boolean("s"))
    assert [r[0] for r in words.collect()] == [True, None]


def test_latest_keeps_incomplete_keys_and_finds_ties(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", day, 1), ("a", None, 2), (None, day, 3), ("b", day, 4), ("b", day, 5)], "k string, t timestamp, id int")
    kept = identity.latest_per_key(df, ["k"], "t", [F.col("id")])
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
    assert [r.k for r in identity.latest_violations(df, ["k"], "t").collect() if r.k] == ["b"]


def test_checked_join_refuses_repeats(spark):
    one = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    two = spark.createDataFrame([(1, "z")], "k int, w string")
    assert joins.checked_join(one, two, ["k"]).count() == 2
    with pytest.raises(ValueError):
        joins.checked_join(two, one, ["k"])


def test_asof_join_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 10, "x"), ("a", 5, 11, "y"), ("a", 6, 12, "z")], "k string, u int, n int, v string")
    out = joins.asof_join(left, right, ["k"], "t", "u", "v", "seen", "n")
    assert rows(out.select("id", "seen"), "id") == [(1, "y"), (2, None)]


def test_group_snapshot_drops_entities_of_older_snapshots(spark):
    df = spark.createDataFrame([("t", "old", 1), ("t", "new", 2), ("t", "late", 9)], "g string, e string, ts int")
    out = joins.asof_group_snapshot(df, ["g"], ["e"], "ts", F.lit(5), F.lit(True), [F.col("ts")])
    assert [r.e for r in out.collect()] == ["new"]


def test_expansion_doubles_rows_and_flips_sign(spark):
    df = spark.createDataFrame([(1, "h", "a", 3)], "id int, home string, away string, margin int")
    sides = [{"team": F.col("home"), "m": F.col("margin")}, {"team": F.col("away"), "m": -F.col("margin")}]
    assert rows(reshape.two_sides(df, sides, ["id"]), "team") == [(1, "a", -3), (1, "h", 3)]
    assert reshape.missing_periods(spark.createDataFrame([("x", 1), ("x", 3)], "k string, w int"), ["k"], "w", 1, 4).first()["missing"] == [2, 4]


def test_quotas_then_flex(spark):
    df = spark.createDataFrame([(i, p, float(s), ok) for i, p, s, ok in [(1, "RB", 9, True), (2, "RB", 8, True), (3, "WR", 7, True), (4, "RB", 30, False), (5, "WR", 6, True)]], "id int, p string, s double, ok boolean")
    out = ranking.fill_quotas(df, [], "p", F.col("ok"), [F.col("s").desc(), F.col("id")], {"RB": 1, "WR": 1}, ["RB", "WR"], 1)
    assert rows(out.select("id", "slot"), "id") == [(1, "STARTER"), (2, "FLEX"), (3, "STARTER"), (4, "INELIGIBLE"), (5, "BENCH")]


def test_metrics_and_intervals(spark):
    df = spark.createDataFrame([("q", i, float(i), float(i) - 2) for i in range(10)], "g string, id int, y double, p double")
    m = metrics.metrics(df, ["g"], "y", "p", ["id"], 3).first()
    assert (m.mae, m.rmse, round(m.spearman, 9), m.top_overlap) == (2.0, 2.0, 1.0, 100.0)
    q = metrics.residual_quantiles(df, ["g"], "y", "p").first()
    assert (q.lower_residual, q.upper_residual) == (2.0, 2.0)
    flat = metrics.metrics(df.withColumn("p", F.lit(1.0)), ["g"], "y", "p", ["id"], 3).first()
    assert flat.spearman is None


def test_checks_and_replay(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    got = {r.check_name: r.status for r in quality.counted_checks(df, {"null": F.col("v").isNull(), "id": F.col("id") < 0}).collect()}
    assert got == {"null": "FAIL", "id": "PASS"}
    other = spark.createDataFrame([(1, 1.0), (3, 2.0)], "id int, v double")
    assert {r.check_name: r.actual for r in quality.replay_difference(df, other, ["id"], ["v"]).collect()} == {"v": 0, "only_old": 1, "only_new": 1, "any_row": 2}
    one = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1)), (2, None, None)], "id int, s string, d date")
    two = spark.createDataFrame([(1, "y", dt.date(2024, 1, 1)), (2, None, dt.date(2024, 1, 2))], "id int, s string, d date")
    assert {r.check_name: r.actual for r in quality.replay_difference(one, two, ["id"], ["s", "d"]).collect()} == {"s": 1, "d": 1, "only_old": 0, "only_new": 0, "any_row": 2}


def test_sources_and_sinks(spark, folder):
    df = spark.createDataFrame([(1, 2023, "a"), (2, 2024, None)], "id int, season int, s string")
    tables.write_partitioned(df, f"{folder}/p", ["season"])
    assert tables.read_history(spark, f"{folder}/p", ["id", "season"], F.col("season") < 2024).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_partitioned(df, f"{folder}/p", ["season"], replace=False)
    tables.write_report(df, f"{folder}/c", ["id"])
    assert tables.read_csv(spark, f"{folder}/c", "id int, season int, s string").count() == 2
    assert tables.publish_if_changed(df, f"{folder}/t") is True
    assert tables.publish_if_changed(df.orderBy(F.desc("id")), f"{folder}/t") is False
    got, missing = tables.select_contract(df, {"id": "bigint", "extra": "double"}, ["id"])
    assert got.dtypes == [("id", "bigint"), ("extra", "double")] and missing == ["extra"]
    with pytest.raises(ValueError):
        tables.select_contract(df, {"id": "bigint"}, ["gone"])


def test_strict_modes_raise(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.where("s is null or s <> 'x'").select(S.number("s", strict=True)).collect()] == [7.0, None]
    with pytest.raises(Exception, match="not a number: x"):
        df.select(S.number("s", strict=True)).collect()
    with pytest.raises(Exception, match="in no split: 9"):
        spark.createDataFrame([(9,)], "y int").select(S.split_label("y", {"a": [1]}, strict=True)).collect()
    day = dt.datetime(2024, 1, 1)
    tied = spark.createDataFrame([("a", day, 1), ("a", day, 2), (None, day, 3), (None, day, 4)], "k string, t timestamp, id int")
    with pytest.raises(ValueError):
        identity.latest_guarded(tied, ["k"], "t")
    assert identity.latest_guarded(tied.where("id <> 2"), ["k"], "t").count() == 3
    names = spark.createDataFrame([(1, "one")], "k int, v string")
    with pytest.raises(Exception, match="no v for 2"):
        facts.preferred_lookup(spark.createDataFrame([(1,), (2,)], "k int"), [(names, "k")], "v", "out").collect()


def test_facts(spark):
    df = spark.createDataFrame([(1, "h", "a", 3, "x"), (1, "a", "h", 5, "y"), (2, "h", "b", 7, "x")], "e int, team string, other string, v int, kind string")
    sums = facts.conditional_sums(df, ["e"], {"all": (F.col("v"), None), "x": (F.col("v"), F.col("kind") == "x"), "z": (F.col("v"), F.col("kind") == "z")})
    assert rows(sums, "e") == [(1, 8, 3, 0), (2, 7, 7, 0)]
    own = facts.with_opponent(df, ["e"], "team", "other", ["v"])
    assert rows(own.select("e", "team", "opponent_v"), "e", "team") == [(1, "a", 3), (1, "h", 5), (2, "h", None)]
    parts = facts.bucket_sums(df, ["e"], F.col("v"), {"low": F.col("v") < 5, "high": F.col("v") > 5}, "total")
    assert rows(parts.select("e", "total", "parts_gap"), "e") == [(1, 8, 5), (2, 7, 0)]
    both = facts.unify({"old": (df, {"k": F.col("e")}), "new": (df, {"k": F.col("v"), "s": F.col("kind")})}, {"k": "bigint", "s": "string"})
    assert both.count() == 6 and both.where("s is null").count() == 3
    assert facts.event_sides(df, ["e"], F.col("team"), F.lit(dt.date(2024, 1, 1))).first().sides == "a @ h"
    assert rows(reshape.numbered(df, ["kind"], ["v"], "place").select("v", "place"), "place") == [(3, 1), (7, 2), (5, 3)]
    weighed = spark.createDataFrame([(1.0, 1), (4.0, 2), (None, 9)], "v double, w int").agg(facts.weighted_mean("v", "w"))
    assert weighed.first()[0] == 3.0


def test_scores_by_profile_and_category(spark):
    df = spark.createDataFrame([("p", 2, 3, None), ("q", 2, None, 4), (None, 1, 1, 1)], "c string, a int, b int, d int")
    assert [r[0] for r in df.select(S.by_category("c", {"p": ["a", "b", "d"], "q": ["d"]})).collect()] == [5, 4, 0]
    scores = S.profile_scores({"one": {"a": 1.0}, "two": {"a": 2.0, "b": 1.0}}, {"two": ("b", [(2, 10.0), (None, 20.0)])})
    assert rows(df.select(*[v.alias(k) for k, v in scores.items()]), "one_points", "two_points") == [(1.0, 13.0), (2.0, 4.0), (2.0, 27.0)]
    assert facts.profile_columns(df.withColumns(scores), ["c"], "one", ["points"]).columns == ["c", "points"]
    assert [r.c for r in df.orderBy(S.in_order("c", ["q"]), F.col("a").desc()).collect()] == ["q", "p", None]
    near = df.select(S.nearest(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(1), F.lit(5)), F.col("a") + 1))
    assert [r[0] for r in near.collect()] == ["x", "x", "x"]


def test_lineup_with_overrides_and_gaps(spark):
    df = spark.createDataFrame([(1, "A", 9.0, False), (2, "A", 8.0, True), (3, "B", 7.0, False)], "id int, p string, s double, gone boolean")
    marked = ranking.with_unavailable(df.withColumn("g", F.lit(1)), "p", F.lit(True), F.col("gone"))
    assert rows(marked.select("id", "override"), "id") == [(1, ""), (2, "UNAVAILABLE"), (3, "")]
    filled = ranking.fill_quotas(marked, ["g"], "p", F.col("usable"), [F.col("s").desc()], {"A": 2, "B": 1}, ["A", "B"], 1)
    gaps = ranking.slot_gaps(filled, ["g"], {"A": 2, "B": 1}, "p", 1)
    assert rows(gaps.select("p", "filled", "gap"), "p") == [("A", 1, 1), ("B", 1, 0), ("FLEX", 0, 1)]


def test_strict_day_mean_and_cutoff_ratios(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 3, 9.0)], "day int, id int, v double")
    strict = windows.global_prior_mean(df, "day", ["id"], "v", "m", strict_day=True)
    assert rows(strict.select("id", "m"), "id") == [(1, None), (2, None), (3, 3.0)]
    history = df.withColumns({"k": F.lit("a"), "f": F.lit(1), "w": F.lit(2.0)})
    out = windows.cutoff_ratios(history, spark.createDataFrame([("a",), ("b",)], "k string"), ["k"], ["day", "id"], F.col("day") < 9, {"r": ("v", "w", 2)}, {"n": ("f", 5)})
    assert rows(out.select("k", "r", "n"), "k") == [("a", 3.25, 3), ("b", None, 0)]


def test_zones_on_the_edges_of_daylight_saving(spark):
    df = spark.createDataFrame([("2024-03-10", "01:59"), ("2024-03-10", "03:00"), ("2024-11-03", "00:30"), ("2024-11-03", "02:00"), ("2024-13-01", "00:00")], "d string, t string")
    got = [str(r[0]) for r in df.select(S.zoned_to_utc("d", "t", "America/New_York")).collect()]
    assert got == ["2024-03-10 06:59:00", "2024-03-10 07:00:00", "2024-11-03 04:30:00", "2024-11-03 07:00:00", "None"]


def test_files_against_their_manifest_and_pushed_filters(spark, folder):
    df = spark.createDataFrame([(1, 2023, "a"), (2, 2024, None), (3, 2024, "c")], "id int, season int, s string")
    tables.write_partitioned(df.coalesce(1), f"{folder}/p", ["season"])
    manifest = spark.createDataFrame([(2023, 1, 1), (2024, 9, 1), (2025, 1, 1)], "season int, n_rows long, n_files long")
    got = rows(tables.reconcile_files(spark, f"{folder}/p", manifest, ["season"], "id:int,s:string").select("season", "status"), "season")
    assert got == [(2023, "PASS"), (2024, "FAIL"), (2025, "FAIL")]
    assert {r.status for r in tables.reconcile_files(spark, f"{folder}/p", manifest, ["season"], "id:int").collect()} == {"FAIL"}
    read = tables.read_history(spark, f"{folder}/p", ["id"], F.col("id") > 1)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "struct<id:int>" in plan and read.count() == 2
    assert tables.history_until(df, "season", "id", 2024, 2).count() == 2
    states = {r.column_name: (r.state, r.n_known) for r in tables.contract_states(df, ["id", "gone"], ["s"]).collect()}
    assert states == {"id": ("PRESENT", 3), "gone": ("MISSING", 0), "season": ("UNEXPECTED", 3), "s": ("FORBIDDEN", 2)}


def test_suites(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "c")], "k int, v string")
    got = {r.check_name: r.actual for r in quality.one_to_one(df, {"m": ("k", "v")}).collect()}
    assert got == {"m_a_to_many_b": 0, "m_b_to_many_a": 1}
    risks = {r.risk: r.action for r in quality.register({"x": (df, "do"), "y": (df.limit(0), "do")}).collect()}
    assert risks == {"x": "do", "y": "NONE"}
    old = spark.createDataFrame([(1, "c", 1.0), (2, "c", 2.0), (3, "d", 3.0)], "k int, g string, p double")
    found = {r.g: (r.n_missing, r.n_mismatch, r.status) for r in quality.parity(old, old.where("k < 3").withColumn("p", F.col("p") + F.when(F.col("k") == 2, 1.0).otherwise(0.0)), ["k"], "g", "p", 1e-9).collect()}
    assert found == {"c": (0, 1, "FAIL"), "d": (1, 0, "FAIL"), "ALL": (1, 1, "FAIL")}
    pairs = joins.disagreements(old, old.withColumn("q", F.lit(1.0)).drop("g", "p"), ["k"], {"p": ("p", "q")})
    assert rows(pairs.select("k", "left_value"), "k") == [(2, "2.0"), (3, "3.0")]


def test_latest_stream(spark, folder):
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, t int, id int").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("k string, t int, id int").parquet(f"{folder}/in")
    q = latest_stream(stream, ["k"], "t", "id").writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("latest_rows").select("k", "id"), "k") == [("a", 2), ("b", 3)]


def test_numbers_and_ranks_of_one_large_group(spark):
    """One group with all rows, ties and nulls among them, over many ranges, against a plain sort."""
    import random

    from tidemark.operators import selection

    r = random.Random(4)
    rows = [(None if k % 5 == 0 else "g", r.choice([None, 1.0, 1.0, r.random(), r.random() * 9]), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    got = {x.id: x.n for x in selection.numbered(df, [], [F.col("v").desc_nulls_last(), F.col("id")], "n").collect()}
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
    assert got == {row[2]: i + 1 for i, row in enumerate(order)}
    own = {x.id: x.n for x in selection.numbered(df, ["g"], [F.col("id").desc()], "n").collect()}
    for g in (None, "g"):
        ids = sorted((x[2] for x in rows if x[0] == g), reverse=True)
        assert [own[i] for i in ids] == list(range(1, len(ids) + 1))
    sums = {x.id: x.s for x in selection.running_sum(df, ["g"], ["id"], "id", "s").collect()}
    assert all(sums[x[2]] == sum(y[2] for y in rows[: x[2]] if y[0] == x[0]) for x in rows[:300])
    known = [x for x in rows if x[0] and x[1] is not None]
    ranks = {x._v: x._rank for x in selection.average_ranks(df.where("g is not null and v is not null"), ["g"], {"v": "v"}).collect()}
    values = sorted(x[1] for x in known)
    assert all(abs(ranks[v] - (values.index(v) + 1 + (values.count(v) - 1) / 2)) < 1e-9 for v in set(values))
    assert selection.numbered(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_spread_rankings_sort_no_group_in_one_task(spark):
    """Windows go over counts by range, over a range, or over the top n; never over the rows of a group."""
    from tidemark.operators import metrics, ranking

    df = spark.range(300).selectExpr("id", "'m' AS m", "id * 7 % 31 AS a", "id * 11 % 37 AS p", "id % 3 AS pos")
    plan = metrics.metrics(df, ["m"], "a", "p", ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x or "- Window [" in x or x.strip(" :+-").startswith("Window [")]
    assert windows and plan.count("WindowGroupLimit") >= 2
    assert not [x for x in windows if "partitionBy" in x and "row_number" not in x and "_part" not in x]
    filled = ranking.fill_quotas(df, [], "pos", F.col("a") > 3, [F.col("p").desc(), F.col("id")], {0: 2, 1: 3}, [1, 2], 4)
    counts = {(x.slot, x["count"]) for x in filled.groupBy("slot").count().collect()}
    assert {("STARTER", 5), ("FLEX", 4)} <= counts and "row_number" not in filled._jdf.queryExecution().executedPlan().toString()


def test_readers_see_whole_versions_through_failing_and_racing_publishes(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    from tidemark.sources import snapshots

    path = f"{folder}/table"
    version = lambda k: spark.range(50).withColumn("v", F.lit(k)).repartition(3)
    first = snapshots.publish(version(1), path)
    assert first["number"] == 1 and snapshots.publish(version(1).orderBy(F.desc("id")), path) is None
    held, stop, seen = snapshots.read(spark, path), [], []

    def reader():
        while not stop:
            rows = snapshots.read(spark, path).groupBy("v").count().collect()
            seen.append([tuple(r) for r in rows])

    def failing():
        raise RuntimeError("the check before the pointer failed")

    with ThreadPoolExecutor(1) as pool:
        reading = pool.submit(reader)
        with pytest.raises(RuntimeError):
            snapshots.publish(version(2), path, before_pointing=failing)
        assert snapshots.current(spark, path)["number"] == 1
        # another publish gets in between writing and pointing: this one changes nothing
        with pytest.raises(snapshots.Conflict):
            snapshots.publish(version(3), path, before_pointing=lambda: snapshots.publish(version(4), path))
        with pytest.raises(snapshots.Conflict):
            snapshots.publish(version(5), path, based_on=1)
        assert snapshots.publish(version(6), path, based_on=2)["number"] == 3
        stop.append(1)
        reading.result()
    assert {x for rows in seen for x in rows} <= {(1, 50), (4, 50), (6, 50)} and all(len(rows) == 1 for rows in seen) and seen
    assert held.first().v == 1 and snapshots.read(spark, path, 2).first().v == 4 and snapshots.read(spark, path).first().v == 6
    with open(f"{path}/pointers/00000004.json", "w") as f:
        f.write('{"version": "ha')  # a pointer that is being written
    assert snapshots.read(spark, path).first().v == 6
    assert snapshots.prune(spark, path, 1) == [1, 2] and snapshots.read(spark, path).count() == 50
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, f"{folder}/nothing")


def test_only_changed_partitions_are_written(spark, folder):
    import os

    from tidemark.sources import snapshots

    path = f"{folder}/parts"
    rows = [(k, "abc"[k % 3] if k % 4 else None, k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, p string, q int")
    snapshots.publish_partitions(df, path, ["p", "q"])
    files = lambda: {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    before = files()
    assert snapshots.publish_partitions(df.repartition(5), path, ["p", "q"]) == {"changed": [], "removed": []} and files() == before
    new = spark.createDataFrame([r if r[0] != 5 else (500, *r[1:]) for r in rows if r[1:] != (None, 0)] + [(1, "new", 7)], df.schema)
    told = snapshots.publish_partitions(new, path, ["p", "q"])
    assert sorted(told["changed"]) == sorted({rows[5][1:], ("new", 7)}) and told["removed"] == [(None, 0)]
    kept = {f for f in before if f"p={rows[5][1]}/q={rows[5][2]}" not in f and "DEFAULT" not in f}
    assert kept <= files() and len(files() & before) == len(kept)
    assert sorted(map(tuple, spark.read.schema(df.schema).parquet(path).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_hot_keys_in_slices_equal_the_plain_windows(spark):
    """One key with nearly all rows, nulls and ties of time, in small slices, against the windows over whole keys."""
    import random

    r = random.Random(8)
    rows = [("hot" if k % 20 else f"k{k % 7}", 2020 + k // 300, k // 3, k, r.choice([None, float(r.randrange(99)), r.randrange(9999) / 100])) for k in range(900)]
    df = spark.createDataFrame(rows, "e string, season int, day int, id int, v double").repartition(6)
    p = windows.Prior(["e"], ["season", "day", "id"], "season")
    plain = windows.prior_features(df, p, ["v"]).drop("v_season_sd")
    spread = windows.spread_prior_features(df, ["e"], ["season", "day", "id"], "season", ["v"], size=40)
    close = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    names = sorted(plain.columns)
    assert {close(x) for x in plain.select(names).collect()} == {close(x) for x in spread.select(names).collect()}
    left, right = df.where("id % 2 = 0").select("e", "day", "id"), df.where("id % 2 = 1").select("e", F.col("day").alias("at"), "v", F.col("id").alias("tie"))
    told = [sorted(map(tuple, joins.asof_join(left, right, ["e"], "day", "at", "v", "seen", "tie", spread=s).select("id", "seen").collect())) for s in (False, True)]
    assert told[0] == told[1] and len(told[0]) == 450
    with pytest.raises(ValueError):
        windows.spread_prior_features(df, ["e"], ["id"], "season", ["v"], size=2)


def test_lookups_that_repeat_a_key_raise(spark):
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="repeats keys"):
        facts.preferred_lookup(rows, [(names, "k")], "v", "out")
    assert {r.out for r in facts.preferred_lookup(rows, [(names.where("v <> 'b'"), "k")], "v", "out").collect()} == {"a", "c"}
