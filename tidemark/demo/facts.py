"""Fact builds: sums with conditional sources, two sides, buckets, profiles, formats, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.history import order_history
from tidemark.demo.registry import Tables, query
from tidemark.functions import scalar as S
from tidemark.operators import facts, identity, joins, reshape
from tidemark.operators.windows import Prior


def trades(t: Tables) -> DataFrame:
    """Lines with month, buyer's and seller's nation, of different nations."""
    return (
        t.lineitem.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
        .withColumn("period", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    )


TRADES = """tr AS (SELECT l.*, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS period, c_nationkey, s_nationkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""


def team_facts(t: Tables) -> DataFrame:
    """Per month, seller and buyer nation: quantities from several conditional sources, and the same of the other direction."""
    q, flag = F.col("l_quantity").cast("long"), F.col("l_returnflag")
    sums = {
        "sold": (q, None), "returned": (q, flag == "R"), "accepted": (q, flag == "A"), "open_quantity": (q, F.col("l_linestatus") == "O"),
        "n_lines": (F.lit(1), None), "n_bulk": (F.lit(1), F.col("l_quantity") > 40), "bulk_returned": (q, (F.col("l_quantity") > 40) & (flag == "R")),
    }
    made = facts.conditional_sums(trades(t), ["period", "s_nationkey", "c_nationkey"], sums)
    made = made.withColumnsRenamed({"s_nationkey": "team", "c_nationkey": "opponent"})
    sided = facts.with_opponent(made, ["period"], "team", "opponent", ["sold", "returned", "n_bulk"])
    zero = F.lit(0).cast("long")
    return sided.select(
        "period", "team", "opponent", "sold", "returned", "accepted", "open_quantity", "n_lines", "n_bulk", "bulk_returned",
        (F.col("sold") - F.col("returned") + F.col("accepted")).alias("net"), F.coalesce("opponent_returned", zero).alias("returned_by_opponent"),
        F.greatest(F.coalesce("opponent_sold", zero) - 6 * F.coalesce("opponent_n_bulk", zero), zero).alias("bought_clipped"), S.flag(F.col("opponent_sold").isNull()).alias("one_sided"),
    )


TEAM_FACTS = f"""{TRADES}, tm AS (SELECT period, s_nationkey AS team, c_nationkey AS opponent, sum(l_quantity::BIGINT)::BIGINT AS sold, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0)::BIGINT AS returned,
  coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A'), 0)::BIGINT AS accepted, coalesce(sum(l_quantity::BIGINT) FILTER (l_linestatus = 'O'), 0)::BIGINT AS open_quantity, count(*) AS n_lines,
  count(*) FILTER (l_quantity > 40) AS n_bulk, coalesce(sum(l_quantity::BIGINT) FILTER (l_quantity > 40 AND l_returnflag = 'R'), 0)::BIGINT AS bulk_returned FROM tr GROUP BY 1, 2, 3),
tf AS (SELECT a.*, a.sold - a.returned + a.accepted AS net, coalesce(b.returned, 0) AS returned_by_opponent, greatest(coalesce(b.sold, 0) - 6 * coalesce(b.n_bulk, 0), 0) AS bought_clipped,
  CASE WHEN b.sold IS NULL THEN 1 ELSE 0 END AS one_sided FROM tm a LEFT JOIN tm b ON a.period = b.period AND a.team = b.opponent AND a.opponent = b.team)"""


@query(f"WITH {TEAM_FACTS} SELECT * FROM tf")
def team_fact_build(t: Tables) -> DataFrame:
    return team_facts(t)


BUCKETS = {"q_0_9": (0, 9), "q_10_19": (10, 19), "q_20_29": (20, 29), "q_30_39": (30, 39), "q_40_plus": (40, 10**6)}


def bucket_facts(t: Tables) -> DataFrame:
    """One row per order and supplier: quantities by size bucket, the total, and whether the parts add up to it."""
    q = F.col("l_quantity").cast("long")
    made = facts.bucket_sums(t.lineitem, ["l_orderkey", "l_suppkey"], q, {n: q.between(a, b) for n, (a, b) in BUCKETS.items()}, "attempts")
    kinds = facts.conditional_sums(t.lineitem, ["l_orderkey", "l_suppkey"], {"made": (q, F.col("l_returnflag") == "N"), "missed": (q, F.col("l_returnflag") == "R"), "blocked": (q, F.col("l_returnflag") == "A")})
    joined = joins.checked_join(made, kinds, ["l_orderkey", "l_suppkey"], kind="one_to_one")
    return joined.withColumn("kinds_gap", F.col("attempts") - F.col("made") - F.col("missed") - F.col("blocked"))


BUCKET_FACTS = f"""bf AS (SELECT l_orderkey, l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS attempts,
  {", ".join(f"coalesce(sum(l_quantity::BIGINT) FILTER (l_quantity::BIGINT BETWEEN {a} AND {b}), 0)::BIGINT AS {n}" for n, (a, b) in BUCKETS.items())},
  coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'N'), 0)::BIGINT AS made, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0)::BIGINT AS missed,
  coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A'), 0)::BIGINT AS blocked FROM lineitem GROUP BY 1, 2),
bg AS (SELECT *, attempts - ({" + ".join(BUCKETS)}) AS parts_gap, attempts - made - missed - blocked AS kinds_gap FROM bf)"""


@query(f"WITH {BUCKET_FACTS} SELECT * FROM bg")
def bucket_fact_build(t: Tables) -> DataFrame:
    return bucket_facts(t)


def history_rows(t: Tables) -> DataFrame:
    """Orders with their context (customer, nation, region), the id of the order's own year, fills and derived measures."""
    lines = facts.conditional_sums(t.lineitem, ["l_orderkey"], {"n_lines": (F.lit(1), None), "quantity": (F.col("l_quantity").cast("long"), None), "n_returned": (F.lit(1), F.col("l_returnflag") == "R")})
    context = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    context = context.select(F.col("c_custkey").alias("o_custkey"), "n_name", "r_name", "c_mktsegment")
    df = joins.checked_join(order_history(t), context, ["o_custkey"])
    df = df.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    crosswalk = facts.period_crosswalk(order_history(t), ["o_custkey"], "season", "o_orderpriority", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    df = df.join(crosswalk.withColumnRenamed("o_orderpriority", "period_id"), ["o_custkey", "season"], "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_lines", "quantity", "n_returned")})
    opportunities = S.by_category("c_mktsegment", {"BUILDING": ["n_lines", "quantity"], "MACHINERY": ["quantity"], "AUTOMOBILE": ["n_lines", "n_returned"]})
    return df.select(
        "o_orderkey", "o_custkey", "season", "n_name", "r_name", "c_mktsegment", "period_id", "n_lines", "quantity", "n_returned", (F.col("n_lines") + F.col("n_returned")).alias("touches"),
        opportunities.cast("long").alias("opportunities"), F.round(S.ratio("quantity", "n_lines"), 4).alias("quantity_per_line"),
    )


HISTORY_ROWS = """hl AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1),
hx AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS season, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS period_id FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2),
hr AS (SELECT o_orderkey, o.o_custkey, year(o_orderdate)::INTEGER AS season, n_name, r_name, c_mktsegment, period_id, coalesce(n_lines, 0) AS n_lines, coalesce(quantity, 0) AS quantity, coalesce(n_returned, 0) AS n_returned
  FROM orders o JOIN customer ON o.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN hl ON l_orderkey = o_orderkey
  LEFT JOIN hx ON hx.o_custkey = o.o_custkey AND hx.season = year(o_orderdate)),
hh AS (SELECT *, n_lines + n_returned AS touches, CASE c_mktsegment WHEN 'BUILDING' THEN n_lines + quantity WHEN 'MACHINERY' THEN quantity WHEN 'AUTOMOBILE' THEN n_lines + n_returned ELSE 0 END::BIGINT AS opportunities,
  round(quantity / nullif(n_lines, 0), 4)::DOUBLE AS quantity_per_line FROM hr)"""


@query(f"WITH {HISTORY_ROWS} SELECT * FROM hh")
def history_build(t: Tables) -> DataFrame:
    return history_rows(t)


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS season, month(o_orderdate)::INTEGER AS period, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 1 FROM orders) ORDER BY season DESC, period, o_totalprice DESC, o_orderkey""")
def completed_results(t: Tables) -> DataFrame:
    """Finished orders of the two latest years, for display."""
    latest = t.orders.agg(F.max(F.year("o_orderdate")).alias("latest"))
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    done = order_history(t).where("o_orderstatus = 'F'").crossJoin(F.broadcast(latest)).where("season >= latest - 1")  # one row
    rows = joins.checked_join(done, names, ["o_custkey"]).select("o_orderkey", "season", F.month("o_orderdate").alias("period"), "c_name", "n_name", "o_totalprice")
    return rows.orderBy(F.col("season").desc(), "period", F.col("o_totalprice").desc(), "o_orderkey")


@query("""SELECT 'periodic' AS format, o_custkey AS entity, year(o_orderdate)::INTEGER AS season, weekofyear(o_orderdate)::INTEGER AS period, NULL::DATE AS happened, o_totalprice AS points FROM orders
UNION ALL SELECT 'timestamped', user_id, year(ts)::INTEGER, weekofyear(ts)::INTEGER, ts::DATE, value FROM events""")
def format_unification(t: Tables) -> DataFrame:
    """A format that states periods and one that states ISO times as text, in one table."""
    periodic = t.orders.select("o_custkey", F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), "o_totalprice")
    stamped = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "value").withColumn("time", F.try_to_timestamp("at", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    planned = {"entity": "bigint", "season": "int", "period": "int", "happened": "date", "points": "double"}
    old = {"entity": F.col("o_custkey"), "season": F.col("season"), "period": F.col("week"), "points": F.col("o_totalprice")}
    new = {"entity": F.col("user_id"), "season": F.year("time"), "period": F.weekofyear("time"), "happened": F.to_date("time"), "points": F.col("value")}
    return facts.unify({"periodic": (periodic, old), "timestamped": (stamped, new)}, planned)


RULES = {"strict": {"made": 3.0, "missed": -2.0, "blocked": -1.0, "q_40_plus": 0.5}, "lenient": {"made": 2.0, "missed": 0.0, "blocked": -0.5, "q_30_39": 0.25, "q_40_plus": 0.75}}
TOTALS = {"strict": ("attempts", [(10.0, 4.0), (40.0, 1.0), (None, -2.0)]), "lenient": ("attempts", [(25.0, 2.0), (None, 0.0)])}


def rule_sql(name: str) -> str:
    column, bands = TOTALS[name]
    case = " ".join(f"WHEN {column} <= {a} THEN {b}" if a is not None else f"ELSE {b}" for a, b in bands)
    return f"({' + '.join(f'{w} * {c}' for c, w in RULES[name].items())} + CASE {case} END)::DOUBLE"


@query(f"WITH {BUCKET_FACTS} SELECT l_orderkey, l_suppkey, {', '.join(f'{rule_sql(n)} AS {n}_points' for n in RULES)} FROM bg")
def profile_scores(t: Tables) -> DataFrame:
    return bucket_facts(t).select("l_orderkey", "l_suppkey", *[v.alias(k) for k, v in S.profile_scores(RULES, TOTALS).items()])


@query(f"WITH {BUCKET_FACTS}, p AS (SELECT l_suppkey, {rule_sql('lenient')} AS points FROM bg) SELECT l_suppkey, sum(points) AS points, max(points) AS best, count(*) AS n FROM p GROUP BY 1")
def profile_totals(t: Tables) -> DataFrame:
    """Totals of a chosen profile."""
    scored = bucket_facts(t).withColumns(S.profile_scores(RULES, TOTALS))
    return facts.profile_columns(scored, ["l_suppkey"], "lenient", ["points"]).groupBy("l_suppkey").agg(F.sum("points").alias("points"), F.max("points").alias("best"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(DISTINCT (l_partkey, l_suppkey)) AS n_pairs FROM lineitem GROUP BY 1""")
def composite_key_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.struct("l_orderkey", "l_linenumber")).alias("n_keys"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("n_pairs")
    )


COVERAGE = """cc AS (SELECT c_mktsegment AS segment, count(*) AS n_rows, round(100.0 * count(o.k) / count(*), 2)::DOUBLE AS percent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') o ON o.k = c_custkey GROUP BY 1)"""


def coverage_rows(t: Tables) -> DataFrame:
    active = t.orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.coverage(t.customer.withColumnRenamed("c_mktsegment", "segment"), active, ["c_custkey"], ["segment"])


@query(f"WITH {COVERAGE} SELECT segment, n_rows, percent, CASE WHEN percent >= 30 THEN 'PASS' ELSE 'FAIL' END AS status FROM cc")
def join_coverage(t: Tables) -> DataFrame:
    """How many customers of each segment have a recent order, against a minimum percentage."""
    return coverage_rows(t).withColumn("status", F.when(F.col("percent") >= 30, "PASS").otherwise("FAIL"))


@query(f"WITH {COVERAGE} SELECT segment, n_rows, percent FROM cc UNION ALL SELECT 'ALL', sum(n_rows)::BIGINT, round(sum(percent * n_rows) / sum(n_rows), 4) FROM cc")
def weighted_coverage(t: Tables) -> DataFrame:
    """Coverage by segment, and row-weighted for all."""
    rows = coverage_rows(t)
    every = rows.agg(F.lit("ALL").alias("segment"), F.sum("n_rows").alias("n_rows"), F.round(facts.weighted_mean("percent", "n_rows"), 4).alias("percent"))
    return rows.unionByName(every)


@query(f"""WITH {TRADES} SELECT l_orderkey, string_agg(DISTINCT n, ' @ ' ORDER BY n) AS sides, strftime(min(o_orderdate), '%a %d %b %Y') AS shown_date
FROM (SELECT l_orderkey, unnest([a.n_name, b.n_name]) AS n FROM tr JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT n) = 2""")
def event_sides_summary(t: Tables) -> DataFrame:
    df = trades(t).select("l_orderkey", "o_orderdate", F.explode(F.array("c_nationkey", "s_nationkey")).alias("n_nationkey"))
    return facts.event_sides(df.join(t.nation, "n_nationkey"), ["l_orderkey"], F.col("n_name"), F.col("o_orderdate"))


WIDTHS = {"p_name": 40, "p_brand": 9, "p_type": 20}


@query("SELECT column_name, longest, width, width - longest AS headroom FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, max(length({c}))::INTEGER AS longest, {w} AS width FROM part" for c, w in WIDTHS.items()) + ")")
def text_headroom(t: Tables) -> DataFrame:
    """Longest value of text columns, against the width that they may have."""
    one = t.part.agg(*[F.max(F.char_length(c)).alias(c) for c in WIDTHS])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("longest"), F.lit(w).alias("width")) for c, w in WIDTHS.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.width") - F.col("r.longest")).alias("headroom"))


@query("""WITH h AS (SELECT user_id, list({'k': (props::JSON ->> 'k')::INTEGER, 'v': value}) AS r, count(*) AS n FROM events WHERE value IS NOT NULL AND (props::JSON ->> 'k') IS NOT NULL GROUP BY 1),
f AS (SELECT user_id, n, list_sort(list_transform(r, lambda x: {'far': abs(x.k - 50), 't': x.k, 'v': x.v}))[1] AS b FROM h) SELECT user_id, n, b.v AS nearest_value FROM f""")
def nearest_in_arrays(t: Tables) -> DataFrame:
    """JSON documents with parallel arrays of times and values: the value nearest to a time."""
    known = t.events.select("user_id", F.from_json("props", "k int")["k"].alias("k"), "value").where("k is not null and value is not null")
    text = known.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list("k").alias("time"), F.collect_list("value").alias("value"))).alias("doc"), F.count("*").alias("n"))
    parsed = text.withColumn("doc", F.from_json("doc", "time array<int>, value array<double>"))
    return parsed.select("user_id", "n", S.nearest(F.col("doc.value"), F.col("doc.time"), F.lit(50)).alias("nearest_value"))


@query("""WITH z AS (SELECT event_id, event_type, ts, value, (SELECT max(ts) FROM events) - INTERVAL 10 DAY AS now FROM events)
SELECT event_id, CASE WHEN event_type = 'click' THEN 'INDOORS' WHEN value > 150 THEN 'RECORDED' WHEN event_id % 7 = 0 THEN 'SKIPPED' WHEN ts < now - INTERVAL 5 DAY THEN 'PAST' WHEN ts > now + INTERVAL 5 DAY THEN 'TOO_FAR' ELSE 'FORECAST' END AS state FROM z""")
def status_ladder(t: Tables) -> DataFrame:
    now = t.events.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("now"))
    days = F.expr("INTERVAL 5 DAYS")
    steps = {"INDOORS": F.col("event_type") == "click", "RECORDED": F.col("value") > 150, "SKIPPED": F.col("event_id") % 7 == 0, "PAST": F.col("ts") < F.col("now") - days, "TOO_FAR": F.col("ts") > F.col("now") + days}
    return t.events.crossJoin(F.broadcast(now)).select("event_id", S.status_ladder(steps, "FORECAST").alias("state"))  # one row


@query("""SELECT event_type, count(*) AS n_rows, count(*) FILTER (event_id % 11 = 0) AS n_unparsed, min(ts)::DATE AS first_date FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS t FROM events) GROUP BY 1""")
def lenient_times(t: Tables) -> DataFrame:
    """ISO texts read leniently, with a count of those that aren't times."""
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("?"), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    df = t.events.select("event_type", "ts", text.alias("text")).withColumn("time", F.try_to_timestamp("text", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return df.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.count_if(F.col("time").isNull() & F.col("text").isNotNull()).alias("n_unparsed"), F.min(F.to_date("ts")).alias("first_date"))


@query("""SELECT p_brand, count(*) FILTER (p_partkey % 13 = 0) AS n_not_finite, count(*) FILTER (p_partkey % 13 <> 0) AS n_finite FROM part GROUP BY 1""")
def finite_check(t: Tables) -> DataFrame:
    """Ratios with a zero denominator in some rows, which floating point makes infinite or undefined."""
    value = F.when(F.col("p_partkey") % 26 == 0, F.lit(float("inf"))).when(F.col("p_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    df = t.part.select("p_brand", value.alias("v"))
    return df.groupBy("p_brand").agg(F.count_if(~S.is_finite("v")).alias("n_not_finite"), F.count_if(S.is_finite("v")).alias("n_finite"))


@query("""SELECT row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#31' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#22' THEN 3 ELSE 4 END, p_brand, p_retailprice DESC, p_partkey)::INTEGER AS place, p_partkey, p_brand, p_retailprice FROM part
WHERE p_brand IN ('Brand#31', 'Brand#12', 'Brand#22', 'Brand#11') AND p_size IN (1, 2, 3, 4, 5, 6) AND p_type IN (SELECT DISTINCT p_type FROM part WHERE p_size = 7) AND p_partkey % 2 IN (0) AND contains(lower(p_name || ' ' || p_type), 'e')""")
def faceted_search(t: Tables) -> DataFrame:
    """Four lists and a name search, in a custom order of categories, then falling price."""
    types = t.part.where("p_size = 7").select("p_type").distinct()
    found = t.part.where(F.col("p_brand").isin("Brand#31", "Brand#12", "Brand#22", "Brand#11") & F.col("p_size").isin(1, 2, 3, 4, 5, 6) & (F.col("p_partkey") % 2).isin(0))
    found = found.join(types, "p_type", "left_semi").where(S.any_contains("E", "p_name", "p_type"))
    rows = found.select("p_partkey", "p_brand", "p_retailprice", S.in_order("p_brand", ["Brand#31", "Brand#12", "Brand#22"]).alias("a"), (-F.col("p_retailprice")).alias("c"))
    return reshape.numbered(rows, ["a", "p_brand"], ["c", "p_partkey"], "place").select("place", "p_partkey", "p_brand", "p_retailprice")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS given, o_orderpriority FROM orders),
r AS (SELECT *, row_number() OVER w AS r, lag(given) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_id FROM a
  WINDOW w AS (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, month(o_orderdate) DESC, (given IS NOT NULL) DESC, (given <> o_orderpriority)::INTEGER ASC NULLS LAST, (o_orderstatus = 'O') DESC, o_orderpriority DESC, o_orderkey DESC))
SELECT o_custkey, o_orderkey, given AS id, previous_id, CASE WHEN previous_id <> given THEN 1 ELSE 0 END AS id_changed FROM r WHERE r = 1""")
def latest_identity_ranked(t: Tables) -> DataFrame:
    """The latest identity of each entity by six levels, with its previous id and whether it changed."""
    given = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    df = t.orders.withColumn("given", given)
    df = df.withColumn("previous_id", Prior(["o_custkey"], ["o_orderdate", "o_orderkey"]).lag("given"))
    order = [F.year("o_orderdate").desc(), F.month("o_orderdate").desc(), F.col("given").isNotNull().desc(), (F.col("given") != F.col("o_orderpriority")).cast("int").asc_nulls_last(),
             (F.col("o_orderstatus") == "O").desc(), F.col("o_orderpriority").desc(), F.col("o_orderkey").desc()]
    best = identity.first_per_key(df, ["o_custkey"], order)
    return best.select("o_custkey", "o_orderkey", F.col("given").alias("id"), "previous_id", S.flag(F.col("previous_id") != F.col("given")).alias("id_changed"))


@query("""SELECT o_custkey, year(o_orderdate)::INTEGER AS season, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def period_crosswalk(t: Tables) -> DataFrame:
    return facts.period_crosswalk(order_history(t), ["o_custkey"], "season", "o_orderpriority", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("""SELECT c_custkey, coalesce(a.n_name, b.n_name) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey""")
def two_level_lookup(t: Tables) -> DataFrame:
    """A preferred lookup, then a second one; a row that neither knows is an error."""
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return facts.preferred_lookup(t.customer, [(names.where("n_regionkey < 3"), "c_nationkey"), (names, "c_nationkey")], "n_name", "nation").select("c_custkey", "nation")
