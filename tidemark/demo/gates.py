"""Gates and suites: event consistency, identities, schedules, publication, risks, parity, refits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.evaluation import MODELS, PREDICTED, predictions
from tidemark.demo.facts import BUCKET_FACTS, TEAM_FACTS, bucket_facts, team_facts
from tidemark.demo.history import CUTOFF, HISTORY, MEASURE, WINDOWS, order_history, prior
from tidemark.demo.records import SIDED, sided
from tidemark.demo.registry import Tables, query
from tidemark.demo.scoring import FLEX, QUOTA, filled_sql, pool, rosters
from tidemark.functions import scalar as S
from tidemark.operators import facts, identity, joins, metrics, quality, ranking, reshape, windows
from tidemark.sources import tables
from tidemark.sources.shared import shared_dir

VERDICT = "difference, status FROM (SELECT *, actual - expected AS difference, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM c)"


def checks_sql(names: dict[str, str], source: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS check_name, 0::BIGINT AS expected, count(*) FILTER ({test}) AS actual FROM {source}" for n, test in names.items())
    return f"c AS ({rows})"


PARTS = {"parts_gap": "parts_gap <> 0", "kinds_gap": "kinds_gap <> 0", "negative": "attempts < 0 OR made < 0", "gap_beyond_one": "abs(parts_gap) > 1"}


@query(f"WITH {BUCKET_FACTS}, {checks_sql(PARTS, 'bg')} SELECT check_name, expected, actual, {VERDICT}")
def sum_of_parts(t: Tables) -> DataFrame:
    """Parts add up to their total in every row, and two sources agree up to an allowed gap of 0 or 1."""
    return quality.counted_checks(bucket_facts(t), {n: F.expr(test) for n, test in PARTS.items()})


EVENTS = {
    "total_is_not_the_sum": "abs(s.total - s.first - s.second) > 0.0001", "margin_is_wrong": "abs(s.margin_sum) > 0.0001", "not_two_sides": "s.n_sides <> 2", "same_sides": "s.lo = s.hi",
    "no_buyer": "s.n_buyers <> 1", "no_parent": "o_orderkey IS NULL", "unknown_nation": "n_nationkey IS NULL", "not_reciprocal": "s.n_other <> 2", "buyer_of_another_nation": "c_nationkey <> s.buyer", "dated_before_order": "l_shipdate < o_orderdate",
}


@query(f"""WITH {SIDED}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n_sides, sum(margin) AS margin_sum, sum(abs(margin)) AS total, max(abs(margin)) AS first, min(abs(margin)) AS second, min(nation) AS lo, max(nation) AS hi,
  sum(is_buyer) AS n_buyers, count(DISTINCT other) AS n_other, max(nation) FILTER (is_buyer = 1) AS buyer FROM x GROUP BY 1, 2, 3, 4),
e AS (SELECT s, o.*, c.c_nationkey, n.n_nationkey, li.l_shipdate FROM s JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2, 3, 4) li USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)
  LEFT JOIN orders o ON o_orderkey = l_orderkey LEFT JOIN customer c ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = s.buyer),
{checks_sql(EVENTS, 'e')} SELECT check_name, expected, actual, {VERDICT}""")
def event_consistency(t: Tables) -> DataFrame:
    """Ten checks on two-sided events: totals, margins, sides, parents, reciprocity, agreement with the schedule.

    Lines with one key have one order and supplier, so either all of them have sides or none: the least ship date comes with the sides,
    and lines aren't read again for it. Keys with a null are no events. Orders meet their customers before events meet them, so that
    events stay where their lines' join has put them, by order."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    size = F.abs("margin")
    s = sided(t, ("l_shipdate",)).where("l_linenumber is not null and l_partkey is not null").groupBy(*key).agg(
        F.count("*").alias("n_sides"), F.sum("margin").alias("margin_sum"), F.sum(size).alias("total"), F.max(size).alias("first"), F.min(size).alias("second"), F.min("nation").alias("lo"), F.max("nation").alias("hi"),
        F.sum("is_buyer").alias("n_buyers"), F.count_distinct("other").alias("n_other"), F.max(F.when(F.col("is_buyer") == 1, F.col("nation"))).alias("buyer"),
        F.min("l_shipdate").alias("l_shipdate"),
    )
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    e = s.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("buyer"), "left")
    return quality.counted_checks(e, {n: F.expr(test.replace("s.", "")) for n, test in EVENTS.items()})


MAPS = {"customer": ("customer", "c_custkey", "c_name"), "supplier": ("supplier", "s_suppkey", "s_name"), "part": ("part", "p_partkey", "p_name"), "nation": ("nation", "n_nationkey", "n_name")}


@query("WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{n}_{x}_to_many_{y}' AS check_name, 0::BIGINT AS expected, (SELECT count(*) FROM (SELECT {p} FROM {table} WHERE {p} IS NOT NULL AND {q} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {q}) > 1)) AS actual"
    for n, (table, a, b) in MAPS.items() for x, y, p, q in (("a", "b", a, b), ("b", "a", b, a))) + f") SELECT check_name, expected, actual, {VERDICT}")
def identity_integrity(t: Tables) -> DataFrame:
    """Identifier maps are one-to-one both ways."""
    found = [quality.one_to_one(getattr(t, table), {n: (a, b)}) for n, (table, a, b) in MAPS.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query("""SELECT o_orderkey, l_linenumber, l_suppkey, l_partkey, 'status' AS attribute, o_orderstatus AS left_value, l_linestatus AS right_value FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IS DISTINCT FROM l_linestatus""")
def attribute_disagreement(t: Tables) -> DataFrame:
    """Lines whose key agrees with their order and whose status doesn't."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    keyed = lines.join(orders, "o_orderkey").select("o_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "o_orderstatus")
    return joins.disagreements(keyed.distinct(), lines, ["o_orderkey", "l_linenumber", "l_suppkey", "l_partkey"], {"status": ("o_orderstatus", "l_linestatus")})


RISKS = """SELECT year(o_orderdate)::INTEGER AS season, count(*) AS n_rows, count(*) FILTER (l_shipdate > o_orderdate) AS n_later, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 90 DAY) AS n_much_later,
max(date_diff('day', o_orderdate::DATE, l_shipdate::DATE))::INTEGER AS most_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


@query(RISKS)
def late_update_risk(t: Tables) -> DataFrame:
    """Rows modified after the event that they belong to."""
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    later = F.col("l_shipdate") > F.col("o_orderdate")
    return df.groupBy(F.year("o_orderdate").alias("season")).agg(
        F.count("*").alias("n_rows"), F.count_if(later).alias("n_later"), F.count_if(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("n_much_later"),
        F.max(F.datediff("l_shipdate", "o_orderdate")).alias("most_days"),
    )


@query("""SELECT risk, n_rows, CASE WHEN n_rows > 0 THEN action ELSE 'NONE' END AS action FROM (SELECT 'orders_without_lines' AS risk, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_rows, 'reload lines' AS action
UNION ALL SELECT 'negative_balance', (SELECT count(*) FROM customer WHERE c_acctbal < 0), 'review credit' UNION ALL SELECT 'lines_without_parts', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)), 'reload parts'
UNION ALL SELECT 'customers_without_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 'mark inactive')""")
def risk_register(t: Tables) -> DataFrame:
    return quality.register({
        "orders_without_lines": (t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "reload lines"),
        "negative_balance": (t.customer.where("c_acctbal < 0"), "review credit"),
        "lines_without_parts": (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"), "reload parts"),
        "customers_without_orders": (t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "mark inactive"),
    })


@query(f"""WITH {TEAM_FACTS}, g AS (SELECT period, least(team, opponent) AS a, greatest(team, opponent) AS b, count(*) AS n_sides FROM tf GROUP BY 1, 2, 3), m AS (SELECT period, team, count(DISTINCT opponent) AS n FROM tf GROUP BY 1, 2)
SELECT g.period, count(*) AS n_games, count(*) FILTER (a = b) AS n_self_play, count(*) FILTER (n_sides > 2) AS n_double_booked, max(t.n_teams) AS n_teams, max(t.most) AS most_opponents, CASE WHEN count(*) FILTER (a = b OR n_sides > 2) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM g JOIN (SELECT period, count(*) AS n_teams, max(n) AS most FROM m GROUP BY 1) t ON t.period = g.period GROUP BY 1""")
def schedule_shape(t: Tables) -> DataFrame:
    """Games and teams per period, none against itself, none booked twice."""
    rows = team_facts(t).select("period", "team", "opponent")
    games = rows.groupBy("period", F.least("team", "opponent").alias("a"), F.greatest("team", "opponent").alias("b")).agg(F.count("*").alias("n_sides"))
    bad, double = F.col("a") == F.col("b"), F.col("n_sides") > 2
    shape = games.groupBy("period").agg(F.count("*").alias("n_games"), F.count_if(bad).alias("n_self_play"), F.count_if(double).alias("n_double_booked"))
    teams = rows.groupBy("period", "team").agg(F.count_distinct("opponent").alias("n")).groupBy("period").agg(F.count("*").alias("n_teams"), F.max("n").alias("most_opponents"))
    return shape.join(teams, "period").withColumn("status", F.when((F.col("n_self_play") == 0) & (F.col("n_double_booked") == 0), "PASS").otherwise("FAIL"))


@query(f"""WITH {TEAM_FACTS}, g AS (SELECT period, count(DISTINCT (least(team, opponent), greatest(team, opponent))) AS n_games, count(*) AS n_sides, sum(one_sided)::BIGINT AS n_one_sided FROM tf GROUP BY 1)
SELECT period, n_games, n_sides, n_one_sided, 2 * n_games - n_sides AS difference, CASE WHEN 2 * n_games - n_sides = n_one_sided THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def stage_coverage(t: Tables) -> DataFrame:
    """Sides are twice the games, but for games that only one side reports."""
    pair = F.struct(F.least("team", "opponent"), F.greatest("team", "opponent"))
    g = team_facts(t).groupBy("period").agg(F.count_distinct(pair).alias("n_games"), F.count("*").alias("n_sides"), F.sum("one_sided").alias("n_one_sided"))
    gap = 2 * F.col("n_games") - F.col("n_sides")
    return g.withColumns({"difference": gap, "status": F.when(gap == F.col("n_one_sided"), "PASS").otherwise("FAIL")})


GATE = {
    "null_key": "c_custkey IS NULL OR c_nationkey IS NULL", "unknown_tier": "slot NOT IN ('STARTER', 'FLEX', 'BENCH', 'INELIGIBLE')", "selected_not_eligible": "slot IN ('STARTER', 'FLEX') AND NOT ok", "negative_score": "spend < 0",
    "over_quota": "slot = 'FLEX' AND flex_rank > 1",
}
RANKS = "count(position_rank) > 0 AND (min(position_rank) <> 1 OR max(position_rank) <> count(position_rank) OR count(DISTINCT position_rank) <> count(position_rank))"


@query(f"""WITH {filled_sql('c_nationkey', QUOTA, 1)}, c AS ({checks_sql(GATE, 's')[6:-1]} UNION ALL SELECT 'rank_set', 0, (SELECT count(*) FROM (SELECT c_nationkey, c_mktsegment FROM s GROUP BY 1, 2 HAVING {RANKS}))
  UNION ALL SELECT 'repeated_key', 0, (SELECT count(*) FROM (SELECT c_custkey FROM s GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'groups_differ', 0, (SELECT count(*) FROM ((SELECT c_nationkey FROM s EXCEPT SELECT n_nationkey FROM nation) UNION ALL (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey EXCEPT SELECT c_nationkey FROM s)))
  UNION ALL SELECT 'future_period', 0, (SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2002-01-01')) SELECT check_name, expected, actual, {VERDICT}""")
def publication_gate(t: Tables) -> DataFrame:
    """What must hold before lineups are published: keys, tiers, eligibility, rank sets, equal groups, no future period."""
    s = rosters(t)
    rows = quality.counted_checks(s, {n: F.expr(test) for n, test in GATE.items()}).select("check_name", "expected", "actual")
    count = lambda df, name: df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("check_name"), F.lit(0).cast("long").alias("expected"), "actual")
    ranks = s.groupBy("c_nationkey", "c_mktsegment").agg(quality.rank_set_violations(s, [], "position_rank").alias("bad")).where("bad")
    have, active = s.select("c_nationkey").distinct(), pool(t).select("c_nationkey").distinct()
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"))
    differ = have.join(nations, "c_nationkey", "left_anti").unionByName(active.join(have, "c_nationkey", "left_anti"))
    future = t.orders.where(F.col("o_orderdate") > F.lit("2002-01-01").cast("timestamp_ntz"))
    for df, name in ((ranks, "rank_set"), (s.groupBy("c_custkey").count().where("count > 1"), "repeated_key"), (differ, "groups_differ"), (future, "future_period")):
        rows = rows.unionByName(count(df, name))
    return quality.verdicts(rows)


KNOWN = {"orders_on_1_january": ("month(o_orderdate) = 1 AND day(o_orderdate) = 1", 0), "urgent_orders": ("o_orderpriority = '1-URGENT'", 10**9), "no_date": ("o_orderdate IS NULL", 0)}


@query("SELECT check_name, expected, actual, actual - expected AS difference, CASE WHEN actual = expected THEN 'EXPECTED' ELSE 'REVIEW' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, {e}::BIGINT AS expected, count(*) FILTER ({test}) AS actual FROM orders" for n, (test, e) in KNOWN.items()) + ")")
def expected_exceptions(t: Tables) -> DataFrame:
    """Known exceptions against how often they are expected."""
    return quality.counted_checks(t.orders, {n: F.expr(test) for n, (test, _) in KNOWN.items()}, "EXPECTED", "REVIEW", {n: e for n, (_, e) in KNOWN.items()})


@query(f"""WITH {HISTORY}, f AS (SELECT season, row_number() OVER w - 1 AS n, row_number() OVER ws - 1 AS ns, lag(o_orderdate) OVER w AS p, lag(season) OVER w AS ps, lag(o_orderpriority) OVER w AS pp, o_orderpriority FROM h {WINDOWS})
SELECT season, count(*) AS n_rows, count(*) FILTER ((n = 0) <> (p IS NULL)) AS first_wrong, count(*) FILTER ((n >= 3) AND ns > n) AS three_wrong, count(*) FILTER ((ps < season) AND ns > 0) AS season_wrong,
  count(*) FILTER (pp <> o_orderpriority) AS n_changed, count(*) FILTER (n >= 3) AS n_three FROM f GROUP BY 1""")
def flag_consistency(t: Tables) -> DataFrame:
    """Flags agree with the counts and values that they stand for."""
    p = prior()
    f = windows.anchors(windows.prior_features(order_history(t), p, [MEASURE]), p, "o_orderdate", "o_orderpriority", "season")
    n, ns = F.col("prior_rows"), F.col("prior_season_rows")
    return f.groupBy("season").agg(
        F.count("*").alias("n_rows"), F.count_if((F.col("is_first") == 1) != F.col("prev_date").isNull()).alias("first_wrong"), F.count_if((F.col("has_three") == 1) & (ns > n)).alias("three_wrong"),
        F.count_if((F.col("new_season") == 1) & (ns > 0)).alias("season_wrong"), F.sum("place_changed").alias("n_changed"), F.sum("has_three").alias("n_three"),
    )


@query(f"""WITH {HISTORY} SELECT season, CASE WHEN season <= 1999 THEN 'training' WHEN season = 2000 THEN 'validation' WHEN season = 2001 THEN 'test' END AS split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities,
  count(*) FILTER (season < 1995 OR season > 2001) AS n_unmapped FROM h GROUP BY 1""")
def split_counts(t: Tables) -> DataFrame:
    """Rows by season and split; a season in no split would raise."""
    splits = {"training": range(1992, 2000), "validation": [2000], "test": [2001]}
    df = order_history(t).withColumn("split", S.split_label("season", splits, strict=True))
    return df.groupBy("season", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_entities"), F.count_if(~F.col("season").between(1995, 2001)).alias("n_unmapped"))


@query(f"""WITH {HISTORY} SELECT CASE WHEN season <= 1999 THEN 'training' WHEN season = 2000 THEN 'validation' ELSE 'test' END AS split, o_orderpriority, min(season) AS first_season, max(season) AS last_season, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities,
  count(*) FILTER (o_totalprice IS NULL) AS n_missing, round(100.0 * count(*) FILTER (o_totalprice = 0) / count(*), 2)::DOUBLE AS zero_percent, round(100.0 * count(*) FILTER (o_totalprice < 0) / count(*), 2)::DOUBLE AS negative_percent, round(avg(o_totalprice), 2) AS mean FROM h GROUP BY 1, 2""")
def split_manifest(t: Tables) -> DataFrame:
    split = S.split_label("season", {"training": range(1992, 2000), "validation": [2000], "test": [2001]}).alias("split")
    value = F.col(MEASURE)
    return order_history(t).groupBy(split, "o_orderpriority").agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_entities"), F.count_if(value.isNull()).alias("n_missing"),
        F.round(100.0 * F.count_if(value == 0) / F.count("*"), 2).alias("zero_percent"), F.round(100.0 * F.count_if(value < 0) / F.count("*"), 2).alias("negative_percent"), F.round(F.avg(value), 2).alias("mean"),
    )


@query("""SELECT column_name, n_null, n_rows, least, greatest FROM (SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS n_null, count(*) AS n_rows, min(o_orderkey)::VARCHAR AS least, max(o_orderkey)::VARCHAR AS greatest FROM orders
UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(*), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(*), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(*), min(o_orderpriority), max(o_orderpriority) FROM orders) ORDER BY n_null DESC, column_name LIMIT 3""")
def null_ranges(t: Tables) -> DataFrame:
    """Columns with most nulls, with their ranges."""
    return quality.null_profile(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ranges=True, top=3)


SAFE = "round(max(gap), 6) AS max_difference, round(avg(gap), 6) AS mean_difference"


@query(f"""WITH {PREDICTED}, q AS (SELECT o_orderkey, o_orderpriority, abs(last5 - prediction) AS gap FROM d WHERE season >= 2000)
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n_rows, 0::BIGINT AS n_missing, count(*) FILTER (gap > 1e-6) AS n_mismatch, {SAFE},
  CASE WHEN count(*) FILTER (gap > 1e-6) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM q GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def prediction_parity(t: Tables) -> DataFrame:
    """Two ways to the same prediction, per category and over all: the last-5 candidate and the fallback chain's result."""
    rows = predictions(t).where("season >= 2000").select("o_orderkey", "o_orderpriority", "last5", "prediction")
    old = rows.select("o_orderkey", "o_orderpriority", F.col("last5").alias("p"))
    found = quality.parity(old, rows.select("o_orderkey", F.col("prediction").alias("p")), ["o_orderkey"], "o_orderpriority", "p", 1e-6)
    return found.withColumns({c: F.round(c, 6) for c in ("max_difference", "mean_difference")})


@query(f"""WITH {PREDICTED}, r AS (SELECT o_orderpriority AS cat2, round(avg(o_totalprice), 6) AS refit FROM h WHERE season <= 2000 GROUP BY 1),
e AS (SELECT o_orderpriority, abs(cm - o_totalprice) AS first_error, abs(refit - o_totalprice) AS refit_error, abs(last5 - o_totalprice) AS champion_error FROM d JOIN m ON cat = o_orderpriority JOIN r ON cat2 = o_orderpriority WHERE season = 2001)
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'ALL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n_rows, round(avg(first_error), 3) AS first_mae, round(avg(refit_error), 3) AS refit_mae, round(avg(champion_error), 3) AS champion_mae,
  round(avg(refit_error) - avg(champion_error), 3) AS gain FROM e GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def final_refit(t: Tables) -> DataFrame:
    """The baseline refitted on training and validation years together, evaluated once on the test year beside the champion."""
    df = predictions(t)
    refit = df.where("season <= 2000").groupBy("o_orderpriority").agg(F.round(F.avg(MEASURE), 6).alias("refit"))
    error = lambda c: F.abs(F.col(c) - F.col(MEASURE))
    e = df.where("season = 2001").join(refit, "o_orderpriority").withColumns({"a": error("category_mean"), "b": error("refit"), "c": error("last5")})
    g = e.rollup("o_orderpriority").agg(F.grouping("o_orderpriority").alias("_all"), F.count("*").alias("n_rows"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("c").alias("c"))
    return g.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "n_rows", F.round("a", 3).alias("first_mae"), F.round("b", 3).alias("refit_mae"),
        F.round("c", 3).alias("champion_mae"), F.round(F.col("b") - F.col("c"), 3).alias("gain"),
    )


@query(f"WITH {PREDICTED} SELECT o_orderpriority, count(*) AS n_rows, round(100.0 * count(p5) / count(*), 2)::DOUBLE AS last5_percent, round(100.0 * count(p1) / count(*), 2)::DOUBLE AS previous_percent, count(*) FILTER (prediction_source <> 'o_totalprice_last5') AS n_fallback FROM d GROUP BY 1")
def baseline_coverage(t: Tables) -> DataFrame:
    """How often a raw feature is known, and how many rows fall back."""
    percent = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 2)
    return predictions(t).groupBy("o_orderpriority").agg(
        F.count("*").alias("n_rows"), percent(f"{MEASURE}_last5").alias("last5_percent"), percent(f"{MEASURE}_prev").alias("previous_percent"), F.count_if(F.col("prediction_source") != f"{MEASURE}_last5").alias("n_fallback")
    )


@query(f"""WITH {filled_sql('c_nationkey', QUOTA, 1)}, q AS (SELECT c_nationkey, c_mktsegment, required FROM (SELECT DISTINCT c_nationkey FROM s), (VALUES {", ".join(f"('{k}', {v})" for k, v in (QUOTA | {"FLEX": 1}).items())}) v(c_mktsegment, required)),
w AS (SELECT c_nationkey, CASE WHEN slot = 'FLEX' THEN 'FLEX' ELSE c_mktsegment END AS c_mktsegment, spend FROM s WHERE slot IN ('STARTER', 'FLEX'))
SELECT q.c_nationkey, q.c_mktsegment, q.required, count(w.spend) AS filled, q.required - count(w.spend) AS gap FROM q LEFT JOIN w ON w.c_nationkey = q.c_nationkey AND w.c_mktsegment = q.c_mktsegment GROUP BY 1, 2, 3""".replace("n >= 5 AS ok", "(n >= 5 AND c_custkey % 10 <> 0) AS ok"))
def lineup_overrides(t: Tables) -> DataFrame:
    """Lineups without unavailable members, and the gaps that remain, the flexible slot included."""
    marked = ranking.with_unavailable(pool(t), "c_mktsegment", F.col("ok"), F.col("c_custkey") % 10 == 0)
    filled = ranking.fill_quotas(marked, ["c_nationkey"], "c_mktsegment", F.col("usable"), [F.col("spend").desc(), F.col("c_custkey")], QUOTA, FLEX, 1)
    return ranking.slot_gaps(filled, ["c_nationkey"], QUOTA, "c_mktsegment", 1)


@query(f"""WITH {filled_sql('c_nationkey', QUOTA, 1)}, z AS (SELECT c_nationkey, c_custkey, spend, slot, row_number() OVER (PARTITION BY c_nationkey ORDER BY spend DESC, c_custkey)::INTEGER AS place, max(spend) OVER (PARTITION BY c_nationkey) AS best FROM s WHERE slot IN ('STARTER', 'FLEX'))
SELECT c_nationkey, c_custkey, spend, slot, place, round(best - spend, 2) AS behind FROM z""")
def side_comparison(t: Tables) -> DataFrame:
    """Every chosen member beside the best of its side, by falling score."""
    chosen = rosters(t).where("slot in ('STARTER', 'FLEX')")
    ranked = ranking.head_per_group(chosen, ["c_nationkey"], [F.col("spend").desc(), F.col("c_custkey")], 1 << 30, "place")
    best = chosen.groupBy("c_nationkey").agg(F.max("spend").alias("best"))
    return ranked.join(best, "c_nationkey").select("c_nationkey", "c_custkey", "spend", "slot", "place", F.round(F.col("best") - F.col("spend"), 2).alias("behind"))


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority, season, dense_rank() OVER (ORDER BY season, o_orderpriority) AS k, row_number() OVER (PARTITION BY season, o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '|7'), o_orderkey) AS r
  FROM (SELECT *, year(o_orderdate)::INTEGER AS season FROM orders)) SELECT o_orderkey, o_orderpriority, season FROM s WHERE r <= 3 + CASE WHEN k <= 5 THEN 1 ELSE 0 END""")
def uneven_sample(t: Tables) -> DataFrame:
    """An equal quota for each stratum, and the remainder one each to the first strata."""
    return ranking.stratified_sample(order_history(t), ["season", "o_orderpriority"], ["o_orderkey"], 3, 7, extra=5).select("o_orderkey", "o_orderpriority", "season")


@query("""WITH g AS (SELECT DISTINCT user_id % 50 AS grp FROM events), u AS (SELECT user_id % 50 AS grp, user_id, count(*) AS n, max(value) AS best FROM events WHERE event_type = 'purchase' AND value > 190 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (best IS NOT NULL) DESC, best DESC NULLS LAST, n DESC, user_id) AS r FROM u)
SELECT g.grp, user_id, coalesce(n, 0) AS n, CASE WHEN user_id IS NULL THEN 'NO ACTIVE MEMBER' ELSE 'PICK' END AS label FROM g LEFT JOIN r ON r.grp = g.grp AND r = 1""")
def active_pick_or_label(t: Tables) -> DataFrame:
    """The active member of each group by preference; a group without one keeps its row under a fallback label."""
    grp = (F.col("user_id") % 50).alias("grp")
    groups = t.events.select(grp).distinct()
    users = t.events.where("event_type = 'purchase' and value > 190").groupBy(grp, "user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    first = ranking.head_per_group(users, ["grp"], [F.col("best").isNotNull().desc(), F.col("best").desc_nulls_last(), F.col("n").desc(), F.col("user_id")], 1)
    label = F.when(F.col("user_id").isNull(), "NO ACTIVE MEMBER").otherwise("PICK")
    return groups.join(first, "grp", "left").select("grp", "user_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), label.alias("label"))


BEFORE = f"year(o_orderdate) < {CUTOFF} OR (year(o_orderdate) = {CUTOFF} AND month(o_orderdate) < 7)"


@query(f"""WITH g AS (SELECT season, count(*) AS n_rows, max(month(o_orderdate)) FILTER (season = {CUTOFF})::INTEGER AS last_period, count(*) FILTER (season > {CUTOFF} OR (season = {CUTOFF} AND month(o_orderdate) >= 7)) AS n_not_before
  FROM (SELECT *, year(o_orderdate)::INTEGER AS season FROM orders) WHERE season < {CUTOFF} OR (season = {CUTOFF} AND month(o_orderdate) <= 6) GROUP BY 1) SELECT season, n_rows, last_period, n_not_before, CASE WHEN n_not_before = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def loaded_history_check(t: Tables) -> DataFrame:
    """All earlier seasons and the current one up to a period, and the proof that nothing at or after the cutoff is in."""
    df = tables.history_until(order_history(t).withColumn("period", F.month("o_orderdate")), "season", "period", CUTOFF, 6)
    at = (F.col("season") > CUTOFF) | ((F.col("season") == CUTOFF) & (F.col("period") >= 7))
    g = df.groupBy("season").agg(F.count("*").alias("n_rows"), F.max(F.when(F.col("season") == CUTOFF, F.col("period"))).alias("last_period"), F.count_if(at).alias("n_not_before"))
    return g.withColumn("status", F.when(F.col("n_not_before") == 0, "PASS").otherwise("FAIL"))


@query(f"""WITH h AS (SELECT o_custkey, l_extendedprice, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {BEFORE}), a AS (SELECT o_custkey, sum(l_extendedprice) FILTER (r <= 3) / nullif(sum(l_quantity) FILTER (r <= 3), 0) AS x, coalesce(sum(returned) FILTER (r <= 5), 0)::BIGINT AS y FROM h GROUP BY 1)
SELECT c_custkey AS o_custkey, round(x, 3) AS price_per_unit_last3, coalesce(y, 0) AS returns_last5 FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def cutoff_ratio_features(t: Tables) -> DataFrame:
    """Trailing ratios and flag sums for target rows that have no row of their own yet."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("returned", S.flag(F.col("l_returnflag") == "R").cast("long"))
    order = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    out = windows.cutoff_ratios(lines, t.customer.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], order, F.expr(BEFORE), {"price_per_unit_last3": ("l_extendedprice", "l_quantity", 3)}, {"returns_last5": ("returned", 5)})
    return out.withColumn("price_per_unit_last3", F.round("price_per_unit_last3", 3))


OTHER = {"prev": "lag(sold) OVER w", "last3": "round(avg(sold) OVER w3, 4)", "last5": "round(avg(sold) OVER w5, 4)", "season": "round(avg(sold) OVER ws, 4)"}


@query(f"""WITH {TEAM_FACTS}, m AS (SELECT opponent, (period - 1) // 12 AS season, period, sum(sold)::BIGINT AS sold, sum(returned)::BIGINT AS returned, count(*) AS n_games FROM tf GROUP BY 1, 2, 3),
f AS (SELECT opponent, period, {", ".join(f"{x} AS sold_{n}" for n, x in OTHER.items())}, {", ".join(f"{x.replace('sold', 'returned')} AS returned_{n}" for n, x in OTHER.items())},
  (row_number() OVER w - 1)::INTEGER AS prior_periods, sum(n_games) OVER w5 AS games_last5, min(sold) OVER w5 AS sold_min5 FROM m
  WINDOW w AS (PARTITION BY opponent ORDER BY season, period), w3 AS (PARTITION BY opponent ORDER BY season, period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY opponent ORDER BY season, period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  ws AS (PARTITION BY opponent, season ORDER BY season, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT tf.period, tf.team, tf.opponent, f.* EXCLUDE (opponent, period) FROM tf JOIN f ON f.opponent = tf.opponent AND f.period = tf.period""")
def opponent_windows(t: Tables) -> DataFrame:
    """Eleven features of what opponents allowed before: lag, last 3, last 5 and season of two measures, counts, least."""
    rows = team_facts(t)
    monthly = rows.groupBy("opponent", "period").agg(F.sum("sold").alias("sold"), F.sum("returned").alias("returned"), F.count("*").alias("n_games")).withColumn("season", F.floor((F.col("period") - 1) / 12))
    p = windows.Prior(["opponent"], ["season", "period"], "season")
    made = {}
    for m in ("sold", "returned"):
        made |= {f"{m}_prev": p.lag(m), f"{m}_last3": F.round(p.mean(m, 3), 4), f"{m}_last5": F.round(p.mean(m, 5), 4), f"{m}_season": F.round(F.avg(m).over(p.to_date), 4)}
    made |= {"prior_periods": p.count(), "games_last5": F.sum("n_games").over(p.last(5)), "sold_min5": F.min("sold").over(p.last(5))}
    features = monthly.withColumns(made).drop("sold", "returned", "n_games", "season")
    return rows.select("period", "team", "opponent").join(features, ["opponent", "period"])


@query(f"""WITH {HISTORY}, f AS (SELECT o_orderkey, row_number() OVER w AS n, row_number() OVER ws AS ns, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap, lag(o_orderpriority) OVER w <> o_orderpriority AS moved, lag(season) OVER w AS ps, season FROM h
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), ws AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT 'first_ever' AS label, o_orderkey, n FROM f WHERE n = 1 UNION ALL SELECT 'second_ever', o_orderkey, n FROM f WHERE n = 2 UNION ALL SELECT 'full_window_3', o_orderkey, n FROM f WHERE n = 4 UNION ALL SELECT 'full_window_5', o_orderkey, n FROM f WHERE n = 6
  UNION ALL SELECT 'first_of_season', o_orderkey, n FROM f WHERE ns = 1 AND n > 1 UNION ALL SELECT 'moved', o_orderkey, n FROM f WHERE moved UNION ALL SELECT 'skipped_season', o_orderkey, n FROM f WHERE season - ps > 1 UNION ALL SELECT 'same_day', o_orderkey, n FROM f WHERE gap = 0)
SELECT label, min(o_orderkey) AS o_orderkey, CASE label WHEN 'first_ever' THEN 0 WHEN 'second_ever' THEN 1 WHEN 'full_window_3' THEN 3 WHEN 'full_window_5' THEN 5 END AS expected, (arg_min(n, o_orderkey) - 1)::INTEGER AS prior_rows,
  CASE WHEN label IN ('first_ever', 'second_ever', 'full_window_3', 'full_window_5') AND arg_min(n, o_orderkey) - 1 <> CASE label WHEN 'first_ever' THEN 0 WHEN 'second_ever' THEN 1 WHEN 'full_window_3' THEN 3 ELSE 5 END THEN 'FAIL' ELSE 'PASS' END AS status FROM c GROUP BY 1""")
def boundary_expectations(t: Tables) -> DataFrame:
    """The first example of eight boundary cases, with the count of earlier rows that it must have."""
    p = windows.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"], "season")
    f = order_history(t).select("o_orderkey", p.count().alias("n"), p.season_count().alias("ns"), F.datediff("o_orderdate", p.lag("o_orderdate")).alias("gap"), (p.lag("o_orderpriority") != F.col("o_orderpriority")).alias("moved"), (F.col("season") - p.lag("season")).alias("seasons"))
    n = F.col("n")
    cases = {"first_ever": n == 0, "second_ever": n == 1, "full_window_3": n == 3, "full_window_5": n == 5, "first_of_season": (F.col("ns") == 0) & (n > 0), "moved": F.col("moved"), "skipped_season": F.col("seasons") > 1, "same_day": F.col("gap") == 0}
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cases.items()]))
    first = f.select("o_orderkey", "n", F.explode(labels).alias("label")).groupBy("label").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("n", "o_orderkey").alias("prior_rows"))
    wanted = F.create_map(*[F.lit(x) for kv in {"first_ever": 0, "second_ever": 1, "full_window_3": 3, "full_window_5": 5}.items() for x in kv])
    rows = first.withColumn("expected", F.try_element_at(wanted, F.col("label")))
    return rows.withColumn("status", F.when(F.col("expected") != F.col("prior_rows"), "FAIL").otherwise("PASS"))


INTERVAL_ROWS = f"""{PREDICTED}, q AS (SELECT o_orderpriority AS cat2, quantile_cont(o_totalprice - prediction, 0.1) AS lo, quantile_cont(o_totalprice - prediction, 0.9) AS hi FROM d WHERE season = 2000 GROUP BY 1),
i AS (SELECT o_orderpriority, count(*) AS n_rows, round(100.0 * avg(CASE WHEN o_totalprice BETWEEN prediction + lo AND prediction + hi THEN 1 ELSE 0 END), 2)::DOUBLE AS coverage, avg(abs(prediction - o_totalprice)) AS mae FROM d JOIN q ON cat2 = o_orderpriority WHERE season = 2001 GROUP BY 1)"""


@query(f"WITH {INTERVAL_ROWS} SELECT o_orderpriority, n_rows, coverage, round(mae, 3) AS mae FROM i UNION ALL SELECT 'ALL', sum(n_rows)::BIGINT, round(sum(coverage * n_rows) / sum(n_rows), 3), round(sum(mae * n_rows) / sum(n_rows), 3) FROM i")
def accuracy_table(t: Tables) -> DataFrame:
    """Interval coverage (of the raw interval) and error per category, and row-weighted for all."""
    df = predictions(t)
    q = metrics.residual_quantiles(df.where("season = 2000"), ["o_orderpriority"], MEASURE, "prediction")
    rows = metrics.interval_coverage(df.where("season = 2001").join(q, "o_orderpriority"), ["o_orderpriority"], MEASURE, "prediction")
    rows = rows.select("o_orderpriority", "n_rows", F.round("coverage", 2).alias("coverage"), "mae")
    every = rows.agg(F.lit("ALL").alias("o_orderpriority"), F.sum("n_rows").alias("n_rows"), F.round(facts.weighted_mean("coverage", "n_rows"), 3).alias("coverage"), facts.weighted_mean("mae", "n_rows").alias("mae"))
    return rows.unionByName(every).withColumn("mae", F.round("mae", 3))


@query(f"""WITH {PREDICTED}, u AS (UNPIVOT (SELECT season, o_orderpriority, o_totalprice, {", ".join(MODELS)} FROM d WHERE season IN (2000, 2001)) ON {", ".join(MODELS)} INTO NAME model VALUE p)
SELECT model, season, o_orderpriority, count(*) AS n_rows, round(avg(p - o_totalprice), 3) AS bias, count(*) FILTER (p > o_totalprice) AS n_over FROM u GROUP BY 1, 2, 3""")
def model_bias(t: Tables) -> DataFrame:
    """Candidates side by side in two seasons: bias and how often each predicts too much."""
    df = predictions(t).where("season in (2000, 2001)")
    long = reshape.stacked(df, ["season", "o_orderpriority", MEASURE], MODELS, "model", "p")
    return long.groupBy("model", "season", "o_orderpriority").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.col("p") - F.col(MEASURE)), 3).alias("bias"), F.count_if(F.col("p") > F.col(MEASURE)).alias("n_over"))


PERIODS = "SELECT *, year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS period FROM orders"
PERIOD_CHECKS = {
    "other_season": f"SELECT count(*) FROM shown WHERE season <> {CUTOFF}", "other_period": f"SELECT count(*) FROM shown WHERE season = {CUTOFF} AND period <> 7",
    "completed_not_before": f"SELECT count(*) FROM completed WHERE season > {CUTOFF} OR (season = {CUTOFF} AND period >= 7)",
    "prior_not_covered": f"SELECT count(*) FROM (SELECT DISTINCT o_custkey, season, period FROM p WHERE season = {CUTOFF} AND period < 7 EXCEPT SELECT o_custkey, season, period FROM completed)",
}


@query(f"""WITH p AS ({PERIODS}), shown AS (SELECT * FROM p WHERE (season = {CUTOFF} AND period = 7) OR o_orderkey % 211 = 0), completed AS (SELECT * FROM p WHERE (season < {CUTOFF} OR (season = {CUTOFF} AND period < 7)) AND o_orderkey % 89 <> 0),
c AS ({" UNION ALL ".join(f"SELECT '{n}' AS check_name, ({q})::BIGINT AS actual" for n, q in PERIOD_CHECKS.items())})
SELECT check_name, 0::BIGINT AS expected, actual, actual AS difference, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def period_purity_gate(t: Tables) -> DataFrame:
    """A published period with rows of other periods, and results that lack some of the earlier ones: the gate says so."""
    p = order_history(t).withColumn("period", F.month("o_orderdate"))
    target, before = (F.col("season") == CUTOFF) & (F.col("period") == 7), (F.col("season") < CUTOFF) | ((F.col("season") == CUTOFF) & (F.col("period") < 7))
    shown, completed = p.where(target | (F.col("o_orderkey") % 211 == 0)), p.where(before & (F.col("o_orderkey") % 89 != 0))
    return quality.period_gate(shown, completed, p, "o_custkey", "season", "period", (CUTOFF, 7))


@query(f"""WITH p AS (SELECT *, CASE WHEN o_orderkey % 97 = 0 THEN season - 1 ELSE season END AS filed FROM ({PERIODS}))
SELECT filed AS season, count(*) AS n_rows, count(*) FILTER (season > {CUTOFF} OR (season = {CUTOFF} AND period >= 7)) AS n_not_before, CASE WHEN count(*) FILTER (season > {CUTOFF} OR (season = {CUTOFF} AND period >= 7)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM p WHERE filed < {CUTOFF} OR (filed = {CUTOFF} AND period <= 6) GROUP BY 1""")
def loaded_files_check(t: Tables) -> DataFrame:
    """History as it lies in partitioned files, loaded by its partitions up to a period; rows are held against their own dates, since
    some are filed under the year before."""
    path = f"{shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    filed = order_history(t).withColumns({"filed": F.col("season") - F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0), "period": F.month("o_orderdate")})
    tables.write_partitioned(filed.select("o_orderkey", "o_orderdate", "filed", "period"), path, ["filed", "period"])
    loaded = tables.history_until(t.spark.read.parquet(path), "filed", "period", CUTOFF, 6)
    late = F.col("o_orderdate") >= F.lit(f"{CUTOFF}-07-01").cast("timestamp_ntz")
    g = loaded.groupBy(F.col("filed").alias("season")).agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_not_before"))
    return g.withColumn("status", F.when(F.col("n_not_before") == 0, "PASS").otherwise("FAIL"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE user_id::VARCHAR END AS code, ts FROM events)
SELECT event_id, code FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM e WHERE trim(code) <> '') WHERE r = 1
UNION ALL SELECT event_id, code FROM e WHERE code IS NULL OR trim(code) = ''""")
def latest_with_incomplete_keys(t: Tables) -> DataFrame:
    """The latest row of every key; rows whose key is unavailable stay as they are."""
    code = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string"))
    df = t.events.select("event_id", code.alias("code"), "ts")
    return identity.latest_per_key(df, ["code"], "ts", [F.col("event_id").desc()]).select("event_id", "code")
