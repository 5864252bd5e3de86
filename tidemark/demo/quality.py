"""Profiles, data-quality suites, manifests and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.history import MEASURE, order_history, prior
from tidemark.demo.registry import Tables, query
from tidemark.operators import quality, selection, windows
from tidemark.sources import tables


@query("""SELECT year(o_orderdate)::INTEGER AS season, o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 5) AS median,
  round(stddev_samp(o_totalprice), 2) AS deviation, min(o_totalprice) AS least, max(o_totalprice) AS most, round(quantile_cont(o_totalprice, 0.1), 5) AS p10, round(quantile_cont(o_totalprice, 0.9), 5) AS p90,
  round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2)::DOUBLE AS final_percent FROM orders GROUP BY 1, 2""")
def distribution_profile(t: Tables) -> DataFrame:
    by = ["season", "o_orderpriority"]
    df = order_history(t)
    plain = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_entities"), F.round(F.avg(MEASURE), 2).alias("mean"),
        F.round(F.stddev_samp(MEASURE), 2).alias("deviation"), F.min(MEASURE).alias("least"), F.max(MEASURE).alias("most"),
        F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 2).alias("final_percent"),
    )
    places = selection.quantiles(df, by, {"q": F.col(MEASURE)}, [0.1, 0.5, 0.9])
    named = {"q_0": "p10", "q_1": "median", "q_2": "p90"}
    return plain.join(places, by).select(*plain.columns, *[F.round(c, 5).alias(n) for c, n in named.items()])


@query("""SELECT column_name, n_null, n_rows FROM (SELECT count(*) AS n_rows, count(*) - count(event_id) AS event_id, count(*) - count(ts) AS ts, count(*) - count(user_id) AS user_id, count(*) - count(event_type) AS event_type,
  count(*) - count(value) AS value, count(*) - count(props) AS props FROM events) UNPIVOT (n_null FOR column_name IN (event_id, ts, user_id, event_type, value, props))""")
def null_profile(t: Tables) -> DataFrame:
    return quality.null_profile(t.events)


@query("""WITH g AS (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1)
SELECT count(*) FILTER (c > 1) AS repeated_keys, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS rows_in_repeated, coalesce(sum(c - 1) FILTER (c > 1), 0)::BIGINT AS excess_rows, coalesce(max(c), 0) AS most_per_key FROM g""")
def dup_profile(t: Tables) -> DataFrame:
    return quality.repeated_keys(t.conversations, ["conv_id"])


CHECKS = """f AS (SELECT o_totalprice, o_orderdate, o_orderstatus, o_orderkey, lag(o_orderdate) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT 'missing_date' AS check_name, count(*) FILTER (o_orderdate IS NULL) AS actual FROM f UNION ALL SELECT 'negative_price', count(*) FILTER (o_totalprice < 0) FROM f
  UNION ALL SELECT 'unknown_status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) FROM f UNION ALL SELECT 'first_row_has_history', count(*) FILTER (n = 1 AND p IS NOT NULL) FROM f
  UNION ALL SELECT 'history_not_before', count(*) FILTER (p > o_orderdate) FROM f UNION ALL SELECT 'late_orders', count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') FROM f),
v AS (SELECT check_name, 0::BIGINT AS expected, actual, actual AS difference, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c)"""


def checks(t: Tables) -> DataFrame:
    p = windows.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"])
    f = order_history(t).withColumns({"p": p.lag("o_orderdate"), "n": p.count()})
    return quality.counted_checks(
        f,
        {
            "missing_date": F.col("o_orderdate").isNull(), "negative_price": F.col(MEASURE) < 0, "unknown_status": ~F.col("o_orderstatus").isin("F", "O", "P"),
            "first_row_has_history": (F.col("n") == 0) & F.col("p").isNotNull(), "history_not_before": F.col("p") > F.col("o_orderdate"),
            "late_orders": F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"),
        },
    )


@query(f"WITH {CHECKS} SELECT * FROM v")
def quality_suite(t: Tables) -> DataFrame:
    return checks(t)


@query(f"WITH {CHECKS} SELECT count(*) AS n_checks, count(*) FILTER (status <> 'PASS') AS n_failed, CASE WHEN count(*) FILTER (status <> 'PASS') = 0 THEN 'READY' ELSE 'BLOCKED' END AS verdict FROM v WHERE check_name <> 'late_orders'")
def readiness_summary(t: Tables) -> DataFrame:
    return quality.readiness(checks(t), ["missing_date", "negative_price", "unknown_status", "first_row_has_history", "history_not_before"])


@query("""WITH c AS (SELECT 'region' AS check_name, 5::BIGINT AS expected, (SELECT count(*) FROM region) AS actual UNION ALL SELECT 'nation', 25, (SELECT count(*) FROM nation) UNION ALL SELECT 'orders_per_line', 0, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))
SELECT *, actual - expected AS difference, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def row_reconciliation(t: Tables) -> DataFrame:
    orphans = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return quality.row_counts({"region": t.region, "nation": t.nation, "orders_per_line": orphans}, {"region": 5, "nation": 25, "orders_per_line": 0})


@query("""WITH p AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag, round(sum(q), 2) AS aggregated_total, count(*) AS n_groups FROM p GROUP BY 1),
a AS (SELECT l_returnflag, round(sum(l_quantity), 2) AS source_total FROM lineitem GROUP BY 1)
SELECT l_returnflag, source_total, aggregated_total, n_groups, CASE WHEN abs(source_total - aggregated_total) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM a JOIN b USING (l_returnflag)""")
def measure_conservation(t: Tables) -> DataFrame:
    """Totals of the source equal those of the aggregate built from it."""
    parts = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    two = parts.groupBy("l_returnflag").agg(F.round(F.sum("q"), 2).alias("aggregated_total"), F.count("*").alias("n_groups"))
    one = t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("source_total"))
    same = F.abs(F.col("source_total") - F.col("aggregated_total")) <= 0.01
    return one.join(two, "l_returnflag").withColumn("status", F.when(same, "PASS").otherwise("FAIL"))


@query("""SELECT unnest(['n_rows', 'n_entities', 'first_date', 'last_date', 'final_percent']) AS key, unnest([count(*)::VARCHAR, count(DISTINCT o_custkey)::VARCHAR, (min(o_orderdate)::DATE)::VARCHAR, (max(o_orderdate)::DATE)::VARCHAR,
  (round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2)::DOUBLE)::VARCHAR]) AS value FROM orders""")
def run_manifest(t: Tables) -> DataFrame:
    percent = F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 2)
    values = {"n_rows": F.count("*"), "n_entities": F.count_distinct("o_custkey"), "first_date": F.min(F.to_date("o_orderdate")), "last_date": F.max(F.to_date("o_orderdate")), "final_percent": percent}
    return tables.key_values(t.orders, values)


@query("""WITH m AS (SELECT year(o_orderdate)::INTEGER AS season, count(*) + CASE WHEN year(o_orderdate) = 1998 THEN 1 ELSE 0 END AS n_stated FROM orders GROUP BY year(o_orderdate)), h AS (SELECT year(o_orderdate)::INTEGER AS season, count(*) AS n_loaded FROM orders GROUP BY 1)
SELECT season, n_stated::BIGINT AS n_stated, n_loaded, CASE WHEN n_stated = n_loaded THEN 'PASS' ELSE 'FAIL' END AS status FROM m JOIN h USING (season)""")
def manifest_reconciliation(t: Tables) -> DataFrame:
    """A manifest that is wrong about one year on purpose."""
    history = order_history(t)
    stated = history.groupBy("season").agg((F.count("*") + F.when(F.col("season") == 1998, 1).otherwise(0)).alias("stated"))
    return tables.reconcile_manifest(history, stated, ["season"], "stated")


@query("""WITH have AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'o_comment']) AS column_name), known AS (SELECT column_name, n FROM (SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey,
  count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice, count(o_orderdate) AS o_orderdate, count(o_orderpriority) AS o_orderpriority FROM orders) UNPIVOT (n FOR column_name IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)))
SELECT h.column_name, CASE WHEN k.column_name IS NULL THEN 'MISSING' WHEN h.column_name = 'o_orderpriority' THEN 'FORBIDDEN' ELSE 'PRESENT' END AS state, coalesce(n, 0) AS n_known FROM have h LEFT JOIN known k USING (column_name)""")
def column_contract(t: Tables) -> DataFrame:
    """Every column of a contract or of the table: missing, unexpected, forbidden or present, and how often it's known."""
    planned = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_comment"]
    return tables.contract_states(t.orders, planned, ["o_orderpriority"])


HASHED = "SELECT '{0}' AS table_name, count(*) AS n_rows, bit_xor(h) AS hash_xor, sum(h)::BIGINT AS hash_sum FROM (SELECT ('0x' || substr(md5(concat_ws('|', {1})), 1, 8))::BIGINT AS h FROM {0})"


@query(" UNION ALL ".join(HASHED.format(t, ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in columns)) for t, columns in {
    "part": ["p_brand", "p_name", "p_partkey", "p_size", "p_type"], "lineitem": ["l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"]}.items()))
def fingerprint(t: Tables) -> DataFrame:
    """Order-free fingerprints of the numbers and texts of two tables, of the second from those of its partitions."""
    one = tables.fingerprint(t.part.select("p_brand", "p_name", "p_partkey", "p_size", "p_type"))
    parts = tables.fingerprint(t.lineitem.select("l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey"), ["l_returnflag"])
    two = parts.agg(F.sum("n_rows").alias("n_rows"), F.bit_xor("hash_xor").alias("hash_xor"), F.sum("hash_sum").alias("hash_sum"))
    return one.withColumn("table_name", F.lit("part")).unionByName(two.withColumn("table_name", F.lit("lineitem")))


@query(f"""SELECT season, count(*) AS n_rows, count(*) FILTER (is_first = 1 AND prev IS NOT NULL) AS n_flag_wrong, count(*) FILTER (is_first = 0 AND prev IS NULL) AS n_null_wrong FROM (
  SELECT year(o_orderdate)::INTEGER AS season, lag(o_totalprice) OVER w AS prev, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS is_first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) GROUP BY 1""")
def null_rule_check(t: Tables) -> DataFrame:
    p = prior()
    f = windows.anchors(windows.prior_features(order_history(t), p, [MEASURE]), p, "o_orderdate", "o_orderpriority", "season")
    known = F.col(f"{MEASURE}_prev").isNotNull()
    return f.groupBy("season").agg(
        F.count("*").alias("n_rows"), F.count_if((F.col("is_first") == 1) & known).alias("n_flag_wrong"), F.count_if((F.col("is_first") == 0) & ~known).alias("n_null_wrong")
    )
