"""Scores, bands, flags, times, quotas and short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.history import order_history, prior
from tidemark.demo.registry import Tables, query
from tidemark.functions import scalar as S
from tidemark.operators import identity, ranking, reshape

BANDS = [(5.0, 5.0), (12.0, 3.0), (25.0, 1.0), (40.0, -1.0), (None, -4.0)]


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, round(0.5 * l_quantity + 10.0 * l_discount - 20.0 * l_tax, 4) AS score,
  CASE WHEN l_quantity <= 5 THEN 5.0 WHEN l_quantity <= 12 THEN 3.0 WHEN l_quantity <= 25 THEN 1.0 WHEN l_quantity <= 40 THEN -1.0 ELSE -4.0 END AS band, round(0.5 * l_quantity, 4) AS stated FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, round(sum(score), 2) AS score, sum(band)::DOUBLE AS band, count(*) FILTER (abs(score - stated) > 1) AS n_mismatch, round(max(abs(score - stated)), 4) AS max_gap FROM s GROUP BY 1""")
def linear_score_reconcile(t: Tables) -> DataFrame:
    score = F.round(S.linear_score({"l_quantity": 0.5, "l_discount": 10.0, "l_tax": -20.0}), 4)
    df = t.lineitem.select("l_returnflag", score.alias("score"), S.band_score("l_quantity", BANDS).alias("band"), F.round(0.5 * F.col("l_quantity"), 4).alias("stated"))
    gap = F.abs(F.col("score") - F.col("stated"))
    return df.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("score"), 2).alias("score"), F.sum("band").alias("band"), F.count_if(gap > 1).alias("n_mismatch"), F.round(F.max(gap), 4).alias("max_gap")
    )


@query("""SELECT p_partkey, CASE WHEN p_size <= 5 THEN 5.0 WHEN p_size <= 12 THEN 3.0 WHEN p_size <= 25 THEN 1.0 WHEN p_size <= 40 THEN -1.0 ELSE -4.0 END::DOUBLE AS band, greatest(p_retailprice - 1000, 0.0) AS above FROM part""")
def band_score(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.band_score("p_size", BANDS).alias("band"), S.floor_at(F.col("p_retailprice") - 1000).alias("above"))


@query("""WITH h AS (SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER w - 1 AS n, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, coalesce(nullif(concat_ws(';', CASE WHEN n < 3 THEN 'FEW_ROWS' END, CASE WHEN gap > 365 THEN 'LONG_GAP' END, CASE WHEN o_totalprice > 400000 THEN 'HIGH_VALUE' END), ''), 'NONE') AS flags,
  CASE WHEN n >= 5 AND gap <= 365 AND o_totalprice IS NOT NULL AND o_orderstatus <> 'P' THEN 'HIGH' WHEN n >= 3 AND gap <= 730 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, 'rows=' || n || ' gap=' || coalesce(gap::VARCHAR, '-') AS reason FROM h""")
def flags_and_confidence(t: Tables) -> DataFrame:
    p = prior()
    df = order_history(t).select("o_orderkey", "o_totalprice", "o_orderstatus", p.count().alias("n"), F.datediff("o_orderdate", p.lag("o_orderdate")).alias("gap"))
    flags = {"FEW_ROWS": F.col("n") < 3, "LONG_GAP": F.col("gap") > 365, "HIGH_VALUE": F.col("o_totalprice") > 400000}
    required = F.col("o_totalprice").isNotNull() & (F.col("o_orderstatus") != "P")
    reason = F.format_string("rows=%s gap=%s", F.col("n").cast("string"), F.coalesce(F.col("gap").cast("string"), F.lit("-")))
    return df.select("o_orderkey", S.flag_list(flags, default="NONE").alias("flags"), S.confidence("n", "gap", [("HIGH", 5, 365), ("MEDIUM", 3, 730)], required=required).alias("confidence"), reason.alias("reason"))


@query("""WITH j AS (SELECT user_id, event_id, (props::JSON ->> 'k')::INTEGER AS k FROM events)
SELECT user_id, arg_min(event_id, (abs(k - 50), event_id)) AS nearest_event, min(abs(k - 50))::INTEGER AS distance, count(k) AS n_known FROM j WHERE k IS NOT NULL GROUP BY 1""")
def json_nearest(t: Tables) -> DataFrame:
    df = t.events.select("user_id", "event_id", F.from_json("props", "k int")["k"].alias("k")).where("k is not null")
    far = F.abs(F.col("k") - 50)
    return df.groupBy("user_id").agg(F.min_by("event_id", F.struct(far, "event_id")).alias("nearest_event"), F.min(far).alias("distance"), F.count("k").alias("n_known"))


@query("""WITH z AS (SELECT event_id, date_trunc('minute', ts) AS local FROM events)
SELECT event_id, strftime(local AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS utc, strftime(local AT TIME ZONE 'America/New_York' AT TIME ZONE 'Europe/Paris', '%Y-%m-%d %H:%M') AS paris,
  CASE WHEN event_id % 3 = 0 THEN 'INDOORS' WHEN local < (SELECT max(ts) FROM events) - INTERVAL 16 DAY THEN 'PAST' ELSE 'RECENT' END AS state FROM z""")
def zone_times(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts").alias("_max"))
    utc = S.zoned_to_utc(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm"), "America/New_York")
    state = F.when(F.col("event_id") % 3 == 0, "INDOORS").when(F.date_trunc("minute", "ts") < F.col("_max") - F.expr("INTERVAL 16 DAYS"), "PAST").otherwise("RECENT")
    df = t.events.crossJoin(F.broadcast(newest))  # one row
    return df.select(
        "event_id", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("utc"), F.date_format(F.from_utc_timestamp(utc, "Europe/Paris"), "yyyy-MM-dd HH:mm").alias("paris"), state.alias("state")
    )


def pool(t: Tables) -> DataFrame:
    spend = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count("*").alias("n"))
    return t.customer.join(spend, "c_custkey").select("c_custkey", "c_nationkey", "c_mktsegment", "spend", (F.col("n") >= 5).alias("ok"))


POOL = "p AS (SELECT c_custkey, c_nationkey, c_mktsegment, spend, n >= 5 AS ok FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
QUOTA = {"BUILDING": 2, "MACHINERY": 2, "AUTOMOBILE": 1}
FLEX = ["BUILDING", "MACHINERY", "FURNITURE"]


def filled_sql(by: str, quota: dict[str, int], flex: int) -> str:
    part = f"{by}, " if by else ""
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quota.items())
    names = ", ".join(f"'{x}'" for x in FLEX)
    return f"""{POOL}, a AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY {part}c_mktsegment, ok ORDER BY spend DESC, c_custkey) END::INTEGER AS position_rank FROM p),
b AS (SELECT *, coalesce(position_rank <= CASE c_mktsegment {case} ELSE 0 END, false) AS base FROM a), r AS (SELECT *, ok AND NOT base AND c_mktsegment IN ({names}) AS rest FROM b),
f AS (SELECT *, CASE WHEN rest THEN row_number() OVER (PARTITION BY {part}rest ORDER BY spend DESC, c_custkey) END::INTEGER AS flex_rank FROM r),
s AS (SELECT *, CASE WHEN NOT ok THEN 'INELIGIBLE' WHEN base THEN 'STARTER' WHEN flex_rank <= {flex} THEN 'FLEX' ELSE 'BENCH' END AS slot FROM f)"""


def rosters(t: Tables) -> DataFrame:
    return ranking.fill_quotas(pool(t), ["c_nationkey"], "c_mktsegment", F.col("ok"), [F.col("spend").desc(), F.col("c_custkey")], QUOTA, FLEX, 1)


@query(f"WITH {filled_sql('', {k: 12 * v for k, v in QUOTA.items()}, 12)} SELECT c_custkey, c_mktsegment, position_rank, flex_rank, slot FROM s")
def quota_slotting(t: Tables) -> DataFrame:
    quota = {k: 12 * v for k, v in QUOTA.items()}
    filled = ranking.fill_quotas(pool(t), [], "c_mktsegment", F.col("ok"), [F.col("spend").desc(), F.col("c_custkey")], quota, FLEX, 12)
    return filled.select("c_custkey", "c_mktsegment", "position_rank", "flex_rank", "slot")


@query(f"WITH {filled_sql('c_nationkey', QUOTA, 1)} SELECT c_nationkey, c_custkey, c_mktsegment, slot FROM s WHERE slot IN ('STARTER', 'FLEX')")
def lineup_optimizer(t: Tables) -> DataFrame:
    return rosters(t).where("slot in ('STARTER', 'FLEX')").select("c_nationkey", "c_custkey", "c_mktsegment", "slot")


@query(f"""WITH {filled_sql('c_nationkey', QUOTA, 1)}, q AS (SELECT c_nationkey, c_mktsegment, required FROM (SELECT DISTINCT c_nationkey FROM s),
  (VALUES {", ".join(f"('{k}', {v})" for k, v in QUOTA.items())}) v(c_mktsegment, required))
SELECT q.c_nationkey, q.c_mktsegment, q.required, count(s.slot) AS filled, q.required - count(s.slot) AS gap FROM q LEFT JOIN s ON s.c_nationkey = q.c_nationkey AND s.c_mktsegment = q.c_mktsegment AND s.slot = 'STARTER' GROUP BY 1, 2, 3""")
def lineup_gaps(t: Tables) -> DataFrame:
    return ranking.slot_gaps(rosters(t), ["c_nationkey"], QUOTA, "c_mktsegment")


@query(f"""WITH {filled_sql('c_nationkey', QUOTA, 1)}, w AS (SELECT c_mktsegment, min(spend) AS weakest FROM s WHERE slot = 'STARTER' GROUP BY 1)
SELECT c_custkey, s.c_mktsegment, spend, round(spend - weakest, 2) AS delta FROM s LEFT JOIN w ON w.c_mktsegment = s.c_mktsegment WHERE slot = 'BENCH' AND c_custkey % 10 <> 0 ORDER BY spend DESC, c_custkey LIMIT 25""")
def waiver_topk(t: Tables) -> DataFrame:
    """The best 25 on no roster and not in a list of the unavailable, against the weakest starter of their position."""
    filled = rosters(t)
    weakest = filled.where("slot = 'STARTER'").groupBy("c_mktsegment").agg(F.min("spend").alias("weakest"))
    free = filled.where("slot = 'BENCH'").join(t.customer.where("c_custkey % 10 = 0").select("c_custkey"), "c_custkey", "left_anti")
    free = free.join(weakest, "c_mktsegment", "left").select("c_custkey", "c_mktsegment", "spend", F.round(F.col("spend") - F.col("weakest"), 2).alias("delta"))
    return free.orderBy(F.col("spend").desc(), "c_custkey").limit(25)


@query(f"WITH {filled_sql('c_nationkey', QUOTA, 1)} SELECT c_nationkey, CASE WHEN slot IN ('STARTER', 'FLEX') THEN 'CHOSEN' ELSE 'REST' END AS side, count(*) AS n, round(sum(spend), 2) AS spend, round(max(spend), 2) AS best, count(*) FILTER (ok) AS n_ok FROM s GROUP BY 1, 2")
def side_summary(t: Tables) -> DataFrame:
    """Sums over each nation's chosen members and over its others."""
    side = F.when(F.col("slot").isin("STARTER", "FLEX"), "CHOSEN").otherwise("REST").alias("side")
    return rosters(t).groupBy("c_nationkey", side).agg(F.count("*").alias("n"), F.round(F.sum("spend"), 2).alias("spend"), F.round(F.max("spend"), 2).alias("best"), F.count_if("ok").alias("n_ok"))


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS n, count(value) AS k, max(ts) AS latest FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY (k > 0) DESC, n DESC, latest DESC NULLS LAST, user_id) AS r FROM u) SELECT event_type, user_id, n, 'PICK' AS label FROM r WHERE r = 1""")
def active_pick(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count("value").alias("k"), F.max("ts").alias("latest"))
    order = [(F.col("k") > 0).desc(), F.col("n").desc(), F.col("latest").desc_nulls_last(), F.col("user_id")]
    return identity.first_per_key(u, ["event_type"], order).select("event_type", "user_id", "n", F.lit("PICK").alias("label"))


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority, year(o_orderdate)::INTEGER AS season, row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderpriority, season FROM s WHERE r <= 8""")
def stratified_sample(t: Tables) -> DataFrame:
    return ranking.stratified_sample(order_history(t), ["season", "o_orderpriority"], ["o_orderkey"], 8, 42).select("o_orderkey", "o_orderpriority", "season")


@query("SELECT p_brand, p_partkey, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def head_per_partition(t: Tables) -> DataFrame:
    return ranking.head_per_group(t.part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3, "r").select("p_brand", "p_partkey", "r")


@query("SELECT c_mktsegment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations, min(o_orderdate)::DATE AS first_after FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-06-01' GROUP BY 1")
def target_period_and_lists(t: Tables) -> DataFrame:
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    df = df.where(F.col("o_orderdate") >= F.lit("1999-06-01").cast("timestamp_ntz"))
    return df.groupBy("c_mktsegment").agg(reshape.ordered_list("n_name").alias("nations"), F.min(F.to_date("o_orderdate")).alias("first_after"))
