"""Versions of tables compared by digests, and distinct counts merged over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.demo.registry import Tables, query
from tidemark.operators import replay, sketches

NEWER = """n AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 500 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_custkey % 500 = 4 THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE o_custkey % 500 <> 5),
b AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s, n.k IS NULL AS lost, abs(p - n.price) > 1e-9 * greatest(1.0, abs(p)) AS dp, s IS DISTINCT FROM n.status AS ds FROM orders LEFT JOIN n ON o_orderkey = n.k),
c AS (SELECT 'o_totalprice' AS check_name, count(*) FILTER (NOT lost AND dp) AS actual FROM b UNION ALL SELECT 'o_orderstatus', count(*) FILTER (NOT lost AND ds) FROM b UNION ALL SELECT 'only_old', count(*) FILTER (lost) FROM b
  UNION ALL SELECT 'only_new', 0 FROM b GROUP BY 1 UNION ALL SELECT 'any_row', count(*) FILTER (lost OR dp OR ds) FROM b)"""


@query(f"WITH {NEWER} SELECT check_name, 0::BIGINT AS expected, actual, actual AS difference, CASE WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def replay_by_ranges(t: Tables) -> DataFrame:
    """All orders against a version in which a few customers' prices and states have changed and a few have gone."""
    group = F.col("o_custkey") % 500
    price = F.when(group == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    newer = t.orders.where(group != 5).withColumns({"o_totalprice": price, "o_orderstatus": F.when(group != 4, F.col("o_orderstatus"))})
    return replay.replay_by_ranges(t.orders, newer, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("""SELECT coalesce(season::VARCHAR, 'ALL') AS period, count(DISTINCT o_custkey) AS n_exact, TRUE AS within_error FROM (SELECT year(o_orderdate) AS season, o_custkey FROM orders) GROUP BY ROLLUP (season)""")
def distinct_by_period(t: Tables) -> DataFrame:
    """Customers by year and over all years, counted exactly, and whether the sketches' counts (those of ALL merged from the
    years') are within four standard errors."""
    orders = t.orders.select(F.year("o_orderdate").cast("string").alias("period"), "o_custkey")
    years = sketches.distinct_sketches(orders, ["period"], ["o_custkey"])
    whole = sketches.merge_sketches(years).withColumn("period", F.lit("ALL"))
    told = sketches.estimates(years.unionByName(whole))
    exact = sketches.exact_distinct(orders, ["period"], ["o_custkey"], "n_exact")
    exact = exact.unionByName(sketches.exact_distinct(orders, [], ["o_custkey"], "n_exact").withColumn("period", F.lit("ALL")))
    gap = F.abs(F.col("n_distinct") - F.col("n_exact"))
    return exact.join(told, "period").select("period", "n_exact", (gap <= 4 * sketches.STANDARD_ERROR * F.col("n_exact") + 1).alias("within_error"))
