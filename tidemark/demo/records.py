"""Records: cleaning, identity, joins, reshaping, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.registry import Tables, query
from tidemark.functions import scalar as S
from tidemark.operators import facts, identity, joins, reshape
from tidemark.sources import tables

STATUS = {"F": "FINAL", "O": "OPEN"}


@query("""WITH d AS (SELECT o_custkey, o_orderstatus, o_orderdate FROM orders), m AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus) AS l FROM d)
SELECT o_custkey, o_orderstatus, count(*) AS n_rows, count(o_orderdate) AS n_dated, count(*) FILTER (o_orderdate = l) AS n_latest FROM m
GROUP BY 1, 2 HAVING count(*) > 1 AND (count(o_orderdate) = 0 OR count(*) FILTER (o_orderdate = l) > 1)""")
def dedup_latest_guarded(t: Tables) -> DataFrame:
    return identity.latest_violations(t.orders.select("o_custkey", "o_orderstatus", "o_orderdate"), ["o_custkey", "o_orderstatus"], "o_orderdate")


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS own, CASE WHEN c_custkey % 5 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS given FROM customer)
SELECT c_custkey, coalesce(own, given) AS resolved_id, CASE WHEN own IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'given' ELSE 'none' END AS resolved_id_source,
  CASE WHEN own <> given THEN 1 ELSE 0 END AS resolved_id_conflict, n_name, CASE WHEN n_name IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status
FROM x LEFT JOIN nation ON n_nationkey = coalesce(own, given)""")
def id_resolution_crosswalk(t: Tables) -> DataFrame:
    own = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))
    given = F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    rows = identity.resolve_ids(t.customer.select("c_custkey", own.alias("own"), given.alias("given")), "own", "given").drop("own", "given")
    return joins.matched_join(rows, t.nation.select(F.col("n_nationkey").alias("resolved_id"), "n_name"), ["resolved_id"])


def sided(t: Tables, more: tuple[str, ...] = ()) -> DataFrame:
    """Both sides of every line, with `more` of its columns. Orders meet their customers first, so that lines, the largest table, move
    once, to their orders; where Spark joins by shuffles, the result is dealt by l_orderkey."""
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    line = (
        t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .where("c_nationkey <> s_nationkey")
    )
    c, s, net = F.col("c_nationkey"), F.col("s_nationkey"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6)
    sides = [{"nation": c, "other": s, "is_buyer": F.lit(1), "margin": -net}, {"nation": s, "other": c, "is_buyer": F.lit(0), "margin": net}]
    return reshape.two_sides(line, sides, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *more])


SIDED = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_nationkey AS c, s_nationkey AS s, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c AS nation, s AS other, 1 AS is_buyer, -net AS margin FROM l UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s, c, 0, net FROM l)"""


@query(f"WITH {SIDED} SELECT * FROM x")
def two_sided_expansion(t: Tables) -> DataFrame:
    return sided(t)


@query(f"""WITH {SIDED}, g AS (SELECT l_orderkey, nation, other, round(sum(margin), 6) AS margin FROM x GROUP BY 1, 2, 3)
SELECT a.l_orderkey, a.nation, a.other, a.margin, b.margin AS opponent_margin FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND a.nation = b.other AND a.other = b.nation""")
def opponent_context(t: Tables) -> DataFrame:
    g = sided(t).groupBy("l_orderkey", "nation", "other").agg(F.round(F.sum("margin"), 6).alias("margin"))
    return facts.with_opponent(g, ["l_orderkey"], "nation", "other", ["margin"]).where("opponent_margin is not null")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), j AS (SELECT o.n AS l, c.n AS r FROM o FULL JOIN c ON o.k = c.k)
SELECT count(*) FILTER (l > 1) AS left_repeated, count(*) FILTER (r > 1) AS right_repeated, count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only,
  count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS "both" FROM j""")
def checked_join_report(t: Tables) -> DataFrame:
    return joins.cardinality(t.orders.withColumnRenamed("o_custkey", "k"), t.customer.withColumnRenamed("c_custkey", "k"), ["k"])


@query("""SELECT doc_id, CASE WHEN d IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT l.doc_id AS l, d.doc_id AS d, coalesce(l.doc_id, d.doc_id) AS doc_id
  FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id) WHERE l IS NULL OR d IS NULL""")
def key_reconciliation(t: Tables) -> DataFrame:
    return joins.key_differences(t.labels, t.documents, ["doc_id"])


@query("""WITH m AS (SELECT DISTINCT o_custkey, month(o_orderdate) AS m FROM orders), g AS (SELECT o_custkey, list(m) AS have FROM m GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(range(1, 13), lambda x: NOT list_contains(have, x)), ',') AS missing, 12 - len(have)::INTEGER AS n_missing FROM g""")
def missing_period(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.month("o_orderdate").alias("m"))
    return reshape.missing_periods(rows, ["o_custkey"], "m", 1, 12).select("o_custkey", F.array_join("missing", ",").alias("missing"), F.size("missing").alias("n_missing"))


@query("""WITH r AS (SELECT o_custkey, count(*) AS n_left, min(o_orderdate)::DATE AS next_date, avg(o_totalprice) AS rate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT c_custkey, coalesce(n_left, 0) AS n_left, next_date, round(coalesce(rate, 0) * coalesce(n_left, 0), 2) AS outlook,
  CASE WHEN next_date IS NULL THEN 'COMPLETED' WHEN next_date < DATE '2000-02-01' THEN 'THIS PERIOD' ELSE 'UPCOMING' END AS plan FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def remaining_periods(t: Tables) -> DataFrame:
    rest = t.orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("c_custkey"))
    rest = rest.agg(F.count("*").alias("n"), F.min(F.to_date("o_orderdate")).alias("next_date"), F.avg("o_totalprice").alias("rate"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    plan = F.when(F.col("next_date").isNull(), "COMPLETED").when(F.col("next_date") < F.lit("2000-02-01").cast("date"), "THIS PERIOD").otherwise("UPCOMING")
    return t.customer.select("c_custkey").join(rest, "c_custkey", "left").select(
        "c_custkey", n.alias("n_left"), "next_date", F.round(F.coalesce("rate", F.lit(0.0)) * n, 2).alias("outlook"), plan.alias("plan")
    )


@query("""SELECT p_partkey, nullif(trim(CASE WHEN p_partkey % 7 = 0 THEN '   ' ELSE '  ' || p_name || ' ' END), '') AS name, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS has_name,
  CASE p_brand WHEN 'Brand#11' THEN 'B-A' WHEN 'Brand#12' THEN 'B-B' ELSE p_brand END AS brand, try_cast(CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS DOUBLE) AS size,
  CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false END AS listed, CASE WHEN p_size <= 20 THEN 'training' WHEN p_size <= 35 THEN 'validation' WHEN p_size <= 50 THEN 'test' END AS split,
  NULL::VARCHAR AS note FROM part""")
def normalise_contract(t: Tables) -> DataFrame:
    p = t.part
    raw = F.when(p.p_partkey % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    df = p.select(
        "p_partkey", S.clean(raw).alias("name"), S.flag(S.available(raw)).alias("has_name"), S.replace_codes("p_brand", {"Brand#11": "B-A", "Brand#12": "B-B"}).alias("brand"),
        S.number(F.when(p.p_partkey % 4 == 0, "n/a").otherwise(p.p_size.cast("string"))).alias("size"),
        S.strict_boolean(F.when(p.p_partkey % 3 == 0, " TRUE").when(p.p_partkey % 3 == 1, "False").otherwise("yes")).alias("listed"),
        S.split_label("p_size", {"training": range(0, 21), "validation": range(21, 36), "test": range(36, 51)}).alias("split"),
    )
    planned = {"p_partkey": "bigint", "name": "string", "has_name": "int", "brand": "string", "size": "double", "listed": "boolean", "split": "string", "note": "string"}
    return tables.select_contract(df, planned, ["p_partkey", "name"])[0]


@query("""SELECT p_partkey, p_name || ' | ' || p_brand AS label, p_retailprice AS price FROM part WHERE p_size IN (1, 5, 10, 15, 20) AND (contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'small'))
  AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07 AND l_quantity > 48 AND l_returnflag = 'N')""")
def search_and_filter(t: Tables) -> DataFrame:
    found = t.part.where(F.col("p_size").isin(1, 5, 10, 15, 20) & (S.any_contains("Bolt", "p_name") | S.any_contains("small", "p_type")))
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    unwanted = t.lineitem.where("l_tax > 0.07 and l_quantity > 48 and l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"))
    found = found.join(wanted, "p_partkey", "left_semi").join(unwanted, "p_partkey", "left_anti")
    return found.select("p_partkey", F.concat_ws(" | ", "p_name", "p_brand").alias("label"), F.col("p_retailprice").alias("price"))


@query("""WITH u AS (SELECT 'order' AS kind, o_custkey AS entity, o_totalprice AS points, o_orderdate AS happened FROM orders UNION ALL
  SELECT 'event', user_id, value, ts FROM events UNION ALL SELECT 'line', o_custkey, l_quantity, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entity, round(sum(points), 2) AS total, count(*) AS n_rows, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(happened)::DATE AS latest,
  round(coalesce(sum(points) FILTER (kind = 'order'), 0), 2) AS order_total FROM u GROUP BY 1""")
def season_totals_union(t: Tables) -> DataFrame:
    shape = ["kind", "entity", "points", "happened"]
    orders = t.orders.select(F.lit("order").alias("kind"), F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("points"), F.col("o_orderdate").alias("happened"))
    events = t.events.select(F.lit("event").alias("kind"), F.col("user_id").alias("entity"), F.col("value").alias("points"), F.col("ts").alias("happened"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.lit("line").alias("kind"), F.col("o_custkey").alias("entity"), F.col("l_quantity").alias("points"), F.col("l_shipdate").alias("happened"))
    every = orders.select(*shape).unionByName(events, allowMissingColumns=True).unionByName(lines)
    return every.groupBy("entity").agg(
        F.round(F.sum("points"), 2).alias("total"), F.count("*").alias("n_rows"), reshape.ordered_list("kind").alias("kinds"), F.max(F.to_date("happened")).alias("latest"),
        F.round(F.coalesce(F.sum(F.when(F.col("kind") == "order", F.col("points"))), F.lit(0.0)), 2).alias("order_total"),
    )
