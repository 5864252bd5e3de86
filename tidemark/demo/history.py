"""Histories: windows before each row, features at a cutoff, as-of joins, global means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.registry import Tables, query
from tidemark.functions.scalar import flag, ratio
from tidemark.operators import identity, joins, quality, ranking, reshape, windows

MEASURE = "o_totalprice"
CUTOFF = 2000
#: Prices in cents: sums of them are exact, in whatever order they are taken.
CENTS = "decimal(18,2)"


def order_history(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", MEASURE, F.year("o_orderdate").alias("season"))


def prior() -> windows.Prior:
    return windows.Prior(["o_custkey"], ["season", "o_orderdate", "o_orderkey"], "season")


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


FEATURES = [f"{MEASURE}_{x}" for x in ("prev", "last3", "last5", "season", "sd5", "min5", "max5", "season_sd")]
WINDOWS = """
WINDOW w AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey),
  w3 AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY o_custkey ORDER BY season, o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  ws AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey),
  wd AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
HISTORY = "h AS (SELECT *, year(o_orderdate)::INTEGER AS season FROM orders)"


@query(f"""WITH {HISTORY} SELECT o_orderkey, o_custkey, season, lag(o_totalprice) OVER w AS o_totalprice_prev,
  round(avg(o_totalprice) OVER w3, 4) AS o_totalprice_last3, round(avg(o_totalprice) OVER w5, 4) AS o_totalprice_last5,
  round(avg(o_totalprice) OVER wd, 4) AS o_totalprice_season, round(stddev_samp(o_totalprice) OVER w5, 4) AS o_totalprice_sd5, round(stddev_samp(o_totalprice) OVER wd, 4) AS o_totalprice_season_sd,
  min(o_totalprice) OVER w5 AS o_totalprice_min5, max(o_totalprice) OVER w5 AS o_totalprice_max5,
  (row_number() OVER w - 1)::INTEGER AS prior_rows, (row_number() OVER ws - 1)::INTEGER AS prior_season_rows,
  lag(o_orderdate::DATE) OVER w AS prev_date, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE)::INTEGER AS days_since,
  CASE WHEN lag(o_orderpriority) OVER w <> o_orderpriority THEN 1 ELSE 0 END AS place_changed,
  CASE WHEN lag(season) OVER w < season THEN 1 ELSE 0 END AS new_season,
  CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS is_first, CASE WHEN row_number() OVER w > 3 THEN 1 ELSE 0 END AS has_three
FROM h {WINDOWS}""")
def prior_row_features(t: Tables) -> DataFrame:
    p = prior()
    df = windows.anchors(windows.prior_features(order_history(t), p, [MEASURE]), p, "o_orderdate", "o_orderpriority", "season")
    return rounded(df, *FEATURES[1:5], FEATURES[7]).drop("o_orderdate", "o_orderpriority", "o_orderstatus", MEASURE)


def line_history(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("""WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (sum(l_extendedprice::DECIMAL(18,2)) OVER w3)::DOUBLE / nullif((sum(l_quantity::DECIMAL(18,2)) OVER w3)::DOUBLE, 0) AS price_per_unit_last3,
  coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w5, 0)::BIGINT AS returns_last5
FROM j WINDOW w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def trailing_ratio_features(t: Tables) -> DataFrame:
    p = windows.Prior(["o_custkey"], ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate"])
    made = {"returned": flag(F.col("l_returnflag") == "R"), "price": F.col("l_extendedprice").cast(CENTS), "units": F.col("l_quantity").cast(CENTS)}
    df = line_history(t).withColumns(made)
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        p.ratio_of_sums("price", "units", 3).alias("price_per_unit_last3"), p.flag_sum("returned", 5).alias("returns_last5"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, (round(sum(l_quantity::BIGINT) OVER w * 1.0::DECIMAL(20,10) / nullif(count(*) OVER w, 0), 4))::DOUBLE AS quantity_last3
FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def integer_mean_scale4(t: Tables) -> DataFrame:
    p = windows.Prior(["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])
    df = t.lineitem.withColumn("quantity", F.col("l_quantity").cast("long"))
    return df.select("l_orderkey", "l_linenumber", "l_suppkey", p.integer_mean("quantity", p.last(3)).cast("double").alias("quantity_last3"))


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS period, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT *, lag(quantity) OVER w AS q_prev, round(avg(quantity) OVER w3, 4) AS q_last3 FROM m WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY period),
  w3 AS (PARTITION BY l_suppkey, l_returnflag ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, l.l_suppkey, q_prev, q_last3 FROM lineitem l JOIN f ON f.l_suppkey = l.l_suppkey AND f.l_returnflag = l.l_returnflag
  AND f.period = year(l.l_shipdate) * 12 + month(l.l_shipdate)""")
def opponent_strength_features(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("period", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    key = ["l_suppkey", "l_returnflag"]
    p = windows.Prior(key, ["period"])
    monthly = rows.groupBy(*key, "period").agg(F.sum("l_quantity").alias("quantity"))
    strength = monthly.select(*key, "period", p.lag("quantity").alias("q_prev"), F.round(p.mean("quantity", 3), 4).alias("q_last3"))
    return joins.checked_join(rows, strength, [*key, "period"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q_prev", "q_last3")


def at_cutoff(t: Tables) -> DataFrame:
    targets = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    before = (F.col("season") < CUTOFF) | ((F.col("season") == CUTOFF) & (F.month("o_orderdate") < 7))
    return windows.cutoff_features(order_history(t), targets, ["o_custkey"], ["season", "o_orderdate", "o_orderkey"], MEASURE, before, F.col("season") == CUTOFF)


@query(f"""WITH h AS (SELECT *, year(o_orderdate) AS season, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
  FROM orders WHERE year(o_orderdate) < {CUTOFF} OR (year(o_orderdate) = {CUTOFF} AND month(o_orderdate) < 7)),
a AS (SELECT o_custkey, max(o_totalprice) FILTER (r = 1) AS p, avg(o_totalprice) FILTER (r <= 3) AS l3, avg(o_totalprice) FILTER (r <= 5) AS l5,
  avg(o_totalprice) FILTER (season = {CUTOFF}) AS s, stddev_samp(o_totalprice) FILTER (r <= 5) AS d, stddev_samp(o_totalprice) FILTER (season = {CUTOFF}) AS ds, min(o_totalprice) FILTER (r <= 5) AS lo,
  max(o_totalprice) FILTER (r <= 5) AS hi, count(*) AS n, count(*) FILTER (season = {CUTOFF}) AS ns FROM h GROUP BY 1)
SELECT c_custkey AS o_custkey, p AS o_totalprice_prev, round(l3, 4) AS o_totalprice_last3, round(l5, 4) AS o_totalprice_last5, round(s, 4) AS o_totalprice_season,
  round(d, 4) AS o_totalprice_sd5, round(ds, 4) AS o_totalprice_season_sd, lo AS o_totalprice_min5, hi AS o_totalprice_max5, coalesce(n, 0) AS prior_rows, coalesce(ns, 0) AS prior_season_rows
FROM customer LEFT JOIN a ON a.o_custkey = c_custkey""")
def cutoff_features(t: Tables) -> DataFrame:
    return rounded(at_cutoff(t), *FEATURES[1:5], FEATURES[7])


REPLAYED = {"prev": "max(v) FILTER (r = 1)", "last3": "avg(v) FILTER (r <= 3)", "last5": "avg(v) FILTER (r <= 5)", "season": "avg(v) FILTER (season = 2000)", "sd5": "stddev_samp(v) FILTER (r <= 5)", "min5": "min(v) FILTER (r <= 5)", "max5": "max(v) FILTER (r <= 5)", "season_sd": "stddev_samp(v) FILTER (season = 2000)"}
REPLAY_NAMES = [f"o_totalprice_{n}" for n in REPLAYED] + ["prior_rows", "prior_season_rows"]


@query(f"""WITH {HISTORY}, e AS (SELECT * FROM h WHERE season < {CUTOFF} OR (season = {CUTOFF} AND month(o_orderdate) < 7)),
a AS (SELECT o_custkey, {", ".join(f"{x} AS o_totalprice_{n}" for n, x in REPLAYED.items())}, count(*) AS prior_rows, count(*) FILTER (season = {CUTOFF}) AS prior_season_rows
  FROM (SELECT *, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY season DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM e) GROUP BY 1),
x AS (SELECT c_custkey AS o_custkey, a.* EXCLUDE (o_custkey, prior_rows, prior_season_rows), coalesce(prior_rows, 0) AS prior_rows, coalesce(prior_season_rows, 0) AS prior_season_rows FROM customer LEFT JOIN a ON a.o_custkey = c_custkey),
p AS (SELECT o_custkey, o_orderkey, o_orderdate, season, o_totalprice, 0 AS target FROM e UNION ALL SELECT c_custkey, NULL, TIMESTAMP '{CUTOFF}-07-01', {CUTOFF}, NULL, 1 FROM customer),
y AS (SELECT * FROM (SELECT o_custkey, target, lag(o_totalprice) OVER w AS o_totalprice_prev, avg(o_totalprice) OVER w3 AS o_totalprice_last3, avg(o_totalprice) OVER w5 AS o_totalprice_last5, avg(o_totalprice) OVER wd AS o_totalprice_season,
  stddev_samp(o_totalprice) OVER w5 AS o_totalprice_sd5, min(o_totalprice) OVER w5 AS o_totalprice_min5, max(o_totalprice) OVER w5 AS o_totalprice_max5, stddev_samp(o_totalprice) OVER wd AS o_totalprice_season_sd, row_number() OVER w - 1 AS prior_rows, row_number() OVER ws - 1 AS prior_season_rows
  FROM p {WINDOWS}) WHERE target = 1),
j AS (SELECT x.o_custkey AS xk, y.o_custkey AS yk, {", ".join(f"(x.{n} IS NULL) <> (y.{n} IS NULL) OR coalesce(abs(x.{n} - y.{n}) > 1e-9 * greatest(1, abs(x.{n})), false) AS {n}" for n in REPLAY_NAMES)} FROM x FULL JOIN y ON x.o_custkey = y.o_custkey),
n AS ({" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (xk IS NOT NULL AND yk IS NOT NULL AND {n}) AS actual FROM j" for n in REPLAY_NAMES)} UNION ALL SELECT 'only_old', count(*) FILTER (yk IS NULL) FROM j UNION ALL SELECT 'only_new', count(*) FILTER (xk IS NULL) FROM j
  UNION ALL SELECT 'any_row', count(*) FILTER (xk IS NULL OR yk IS NULL OR {" OR ".join(REPLAY_NAMES)}) FROM j)
SELECT check_name, 0::BIGINT AS expected, actual, actual AS difference, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n""")
def cutoff_replay_diff(t: Tables) -> DataFrame:
    """Features at the cutoff equal those of the windows on a placeholder row that stands right after it."""
    history = order_history(t).where((F.col("season") < CUTOFF) | ((F.col("season") == CUTOFF) & (F.month("o_orderdate") < 7)))
    place = t.customer.select(
        F.lit(None).cast("long").alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit(f"{CUTOFF}-07-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit(CUTOFF).alias("season"), F.lit(None).cast("double").alias(MEASURE), F.lit(1).alias("target"),
    )
    both = history.withColumn("target", F.lit(0)).unionByName(place, allowMissingColumns=True)
    replay = windows.prior_features(both, prior(), [MEASURE]).where("target = 1")
    return quality.replay_difference(at_cutoff(t), replay, ["o_custkey"], [*FEATURES, "prior_rows", "prior_season_rows"])


#: Weights of the own history and of the other side's.
BLENDS = {"own": (1.0, 0.0), "other": (0.0, 1.0), "even": (0.5, 0.5), "mostly_own": (0.75, 0.25), "mostly_other": (0.25, 0.75), "damped": (0.6, 0.3)}


def blend_rows(t: Tables) -> DataFrame:
    own = windows.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"])
    other = windows.Prior(["o_orderpriority"], ["day"])
    cents = F.col(MEASURE).cast(CENTS)
    df = order_history(t).withColumn("day", F.to_date("o_orderdate"))
    # the category's history is by day, so that no category is sorted row by row in one task
    daily = df.groupBy("o_orderpriority", "day").agg(F.sum(cents).alias("_s"), F.count(MEASURE).alias("_n"))
    daily = daily.select("o_orderpriority", "day", ratio(F.sum("_s").over(other.last(5)).cast("double"), F.sum("_n").over(other.last(5))).alias("cat"))
    df = df.withColumn("cents", cents).withColumn("own", own.exact_mean("cents", 5)).join(daily, ["o_orderpriority", "day"], "left")
    # a side without history takes the mean of all earlier days
    df = windows.global_prior_mean(df, "day", ["o_orderkey"], "cents", "prior", strict_day=True)
    own_side, other_side = F.coalesce("own", "prior"), F.coalesce("cat", "prior")
    return df.withColumns({k: a * own_side + b * other_side for k, (a, b) in BLENDS.items()})


BLEND_SQL = f"""{HISTORY}, d AS (SELECT o_orderpriority, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(18,2)) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT o_orderpriority, day, (sum(s) OVER w)::DOUBLE / nullif(sum(n) OVER w, 0) AS cat FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
g AS (SELECT day, (sum(s) OVER w)::DOUBLE / nullif(sum(n) OVER w, 0) AS prior FROM (SELECT day, sum(s) AS s, sum(n) AS n FROM d GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE / nullif(count(o_totalprice) OVER w, 0) AS own_mean FROM h
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
b AS (SELECT o.*, {", ".join(f"({a}::DOUBLE * coalesce(own_mean, prior) + {b}::DOUBLE * coalesce(cat, prior)) AS {k}" for k, (a, b) in BLENDS.items())}
  FROM o LEFT JOIN c ON c.o_orderpriority = o.o_orderpriority AND c.day = o.o_orderdate::DATE LEFT JOIN g ON g.day = o.o_orderdate::DATE)"""


@query(f"WITH {BLEND_SQL} SELECT o_orderkey, {', '.join(BLENDS)} FROM b")
def prior_blend_candidates(t: Tables) -> DataFrame:
    return blend_rows(t).select("o_orderkey", *BLENDS)


@query(f"""WITH {BLEND_SQL}, u AS (UNPIVOT (SELECT season, o_totalprice, {", ".join(BLENDS)} FROM b) ON {", ".join(BLENDS)} INTO NAME model VALUE p),
e AS (SELECT model, avg(abs(p - o_totalprice)) FILTER (season = 1999) AS v, avg(abs(p - o_totalprice)) FILTER (season = 2000) AS t FROM u GROUP BY 1)
SELECT model, round(v, 2) AS validation_mae, round(t, 2) AS test_mae FROM e ORDER BY v, model LIMIT 1""")
def blend_selection(t: Tables) -> DataFrame:
    """The blend with least error in one season, evaluated on the next."""
    long = reshape.stacked(blend_rows(t), ["season", MEASURE], list(BLENDS), "model", "p")
    error = F.abs(F.col("p") - F.col(MEASURE))
    by = long.groupBy("model").agg(F.avg(F.when(F.col("season") == 1999, error)).alias("v"), F.avg(F.when(F.col("season") == 2000, error)).alias("t"))
    best = by.agg(F.min_by(F.struct("model", "v", "t"), F.struct("v", "model")).alias("b"))
    return best.select("b.model", F.round("b.v", 2).alias("validation_mae"), F.round("b.t", 2).alias("test_mae"))


@query("""SELECT o_orderkey, round((sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE / nullif(count(*) OVER w, 0), 3) AS prior_mean FROM orders
WINDOW w AS (ORDER BY o_orderdate::DATE, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def global_prior_mean(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col(MEASURE).cast(CENTS).alias("cents"))
    return windows.global_prior_mean(df, "day", ["o_orderkey"], "cents", "prior_mean").select("o_orderkey", F.round("prior_mean", 3).alias("prior_mean"))


@query(f"""WITH {HISTORY}, g AS (SELECT season, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap, lag(o_orderdate) OVER w > o_orderdate AS bad FROM h
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT season, count(*) AS n_rows, count(gap) AS n_gaps, count(*) FILTER (gap BETWEEN 11 AND 20) AS n_bye_gaps, count(*) FILTER (gap > 10) AS n_long_gaps,
  count(*) FILTER (bad) AS n_disordered, min(gap)::INTEGER AS min_gap, max(gap)::INTEGER AS max_gap FROM g GROUP BY 1""")
def bye_gap_and_chronology(t: Tables) -> DataFrame:
    p = windows.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"])
    df = order_history(t).select("season", F.datediff("o_orderdate", p.lag("o_orderdate")).alias("gap"), (p.lag("o_orderdate") > F.col("o_orderdate")).alias("bad"))
    return df.groupBy("season").agg(
        F.count("*").alias("n_rows"), F.count("gap").alias("n_gaps"), F.count_if(F.col("gap").between(11, 20)).alias("n_bye_gaps"), F.count_if(F.col("gap") > 10).alias("n_long_gaps"),
        F.count_if("bad").alias("n_disordered"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
    )


@query(f"""WITH {HISTORY}, f AS (SELECT o_orderkey, row_number() OVER w AS n, row_number() OVER ws AS ns, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap FROM h
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), ws AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT 'first_ever' AS label, o_orderkey FROM f WHERE n = 1 UNION ALL SELECT 'first_of_season', o_orderkey FROM f WHERE ns = 1 AND n > 1
  UNION ALL SELECT 'third', o_orderkey FROM f WHERE n = 3 UNION ALL SELECT 'long_gap', o_orderkey FROM f WHERE gap > 300)
SELECT label, min(o_orderkey) AS o_orderkey FROM c GROUP BY 1""")
def boundary_examples(t: Tables) -> DataFrame:
    """The first example of each boundary case, all cases in one scan."""
    p = windows.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"], "season")
    f = order_history(t).select("o_orderkey", p.count().alias("n"), p.season_count().alias("ns"), F.datediff("o_orderdate", p.lag("o_orderdate")).alias("gap"))
    cases = {"first_ever": F.col("n") == 0, "first_of_season": (F.col("ns") == 0) & (F.col("n") > 0), "third": F.col("n") == 2, "long_gap": F.col("gap") > 300}
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cases.items()]))
    return ranking.head_per_group(f.select("o_orderkey", F.explode(labels).alias("label")), ["label"], [F.col("o_orderkey")], 1).select("label", "o_orderkey")


@query("""WITH n AS (SELECT *, max(ts) OVER (PARTITION BY event_type) AS m FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS r FROM n WHERE ts = m AND value IS NOT NULL)
SELECT event_type, user_id, event_id, value FROM s WHERE r = 1""")
def asof_group_snapshot(t: Tables) -> DataFrame:
    cutoff = t.events.agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("_cutoff"))
    df = t.events.crossJoin(F.broadcast(cutoff))  # one row
    rows = joins.asof_group_snapshot(df, ["event_type"], ["user_id"], "ts", F.col("_cutoff"), F.col("value").isNotNull(), [F.col("value").desc(), F.col("event_id")])
    return rows.select("event_type", "user_id", "event_id", "value")


@query("""SELECT e.event_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type <> 'click' AND p.ts <= e.ts AND p.value IS NOT NULL) AS seen
FROM events e WHERE e.event_type = 'click'""")
def asof_per_row(t: Tables) -> DataFrame:
    clicks, rest = t.events.where("event_type = 'click'").select("user_id", "event_id", "ts"), t.events.where("event_type <> 'click' and value is not null")
    return joins.asof_join(clicks, rest.select("user_id", F.col("event_id").alias("mark"), "ts", "value"), ["user_id"], "ts", "ts", "value", "seen", "mark").select("event_id", "seen")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY 1, 2""")
def latest_identity(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n_events"))
    latest = identity.latest_per_key(t.events, ["user_id", "event_type"], "ts", [F.col("event_id").desc()])
    return latest.select("user_id", "event_type", "event_id").join(n, ["user_id", "event_type"])


@query("""SELECT o_orderkey, o_orderstatus, p, round(m3, 6) AS last3, round(m5, 6) AS last5, ms AS season_mean, round(sd, 4) AS sd5, lo AS min5, hi AS max5, n AS prior_rows, ns AS prior_season_rows FROM (
  SELECT o_orderkey, o_orderstatus, lag(o_totalprice) OVER w AS p, avg(o_totalprice) OVER w3 AS m3, avg(o_totalprice) OVER w5 AS m5, sum((round(o_totalprice * 100))::BIGINT) OVER ws / 100.0 / nullif(count(o_totalprice) OVER ws, 0) AS ms, stddev_samp(o_totalprice) OVER w5 AS sd, min(o_totalprice) OVER w5 AS lo,
    max(o_totalprice) OVER w5 AS hi, (row_number() OVER w - 1)::INTEGER AS n, row_number() OVER (PARTITION BY o_orderstatus, season ORDER BY o_orderdate, o_orderkey) - 1 AS ns FROM (SELECT *, year(o_orderdate) AS season FROM orders)
  WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), w3 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    w5 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ws AS (PARTITION BY o_orderstatus, season ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def hot_key_features(t: Tables) -> DataFrame:
    """Prior-row features of three keys that have all rows, in slices."""
    f = windows.spread_prior_features(order_history(t), ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "season", [MEASURE], size=2000)
    rounded = [F.round(f"{MEASURE}_{c}", n).alias(c) for c, n in {"last3": 6, "last5": 6, "sd5": 4}.items()] + [F.col(f"{MEASURE}_season").alias("season_mean")]
    return f.select("o_orderkey", "o_orderstatus", F.col(f"{MEASURE}_prev").alias("p"), *rounded, F.col(f"{MEASURE}_min5").alias("min5"), F.col(f"{MEASURE}_max5").alias("max5"), "prior_rows", F.col("prior_season_rows").cast("long").alias("prior_season_rows"))


@query("""WITH u AS (SELECT event_type, ts, event_id, event_id % 3 > 0 AS asks, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events WHERE event_id % 3 > 0 OR value IS NOT NULL)
SELECT event_id, event_type, seen FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, asks, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM u) WHERE asks""")
def hot_key_asof(t: Tables) -> DataFrame:
    """The latest value at or before each event's time, for five keys that have all rows."""
    asks, known = t.events.where("event_id % 3 > 0").select("event_id", "event_type", "ts"), t.events.where("event_id % 3 = 0 and value is not null").select("event_id", "event_type", F.col("ts").alias("at"), "value")
    return joins.asof_join(asks, known, ["event_type"], "ts", "at", "value", "seen", "event_id", spread=True).select("event_id", "event_type", "seen")
