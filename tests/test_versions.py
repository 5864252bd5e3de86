"""Versions compared by digests of ranges, and distinct counts from merged sketches."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, replay, sketches

DATA = "/root/testdata/sf0.01"


def versions(spark):
    old = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"), F.concat(F.lit("t"), F.col("id") % 7).alias("s"))
    changed = F.when(F.col("k") == 77, F.lit(-1.0)).when(F.col("k") == 78, F.col("v") + 1e-13).otherwise(F.col("v"))
    text = F.when(F.col("k") == 79, None).otherwise(F.col("s"))
    new = old.where("k <> 80").select("k", changed.alias("v"), text.alias("s")).union(spark.createDataFrame([(20001, 1.0, "new")], old.schema))
    return old, new


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_give_what_whole_tables_give(spark):
    old, new = versions(spark)
    for a, b in ((old, new), (new, old), (old, old), (old, new.limit(0)), (old.limit(0), new.limit(0))):
        for n in (1, 64, replay.RANGES):
            assert rows(replay.replay_by_ranges(a, b, ["k"], ["v", "s"], ranges=n)) == rows(quality.replay_difference(a, b, ["k"], ["v", "s"]))


def test_rows_of_equal_ranges_are_not_compared(spark):
    old, new = versions(spark)
    same = replay.differing_ranges(old, old.repartition(7), ["k"], ["v", "s"])
    assert same.count() == 0 and replay.rows_in(old, ["k"], same).count() == 0
    few = replay.differing_ranges(old, new, ["k"], ["v", "s"])
    assert 1 <= few.count() <= 5 and replay.rows_in(old, ["k"], few).count() < 100


def test_digests_see_repeats_nulls_and_missing_keys(spark):
    make = lambda *x: spark.createDataFrame(x, "k long, v string, w string")
    differ = lambda a, b: replay.differing_ranges(a, b, ["k"], ["v", "w"]).count()
    assert differ(make((1, "a", "b")), make((1, "a", "b"), (1, "a", "b"))) == 1
    assert differ(make((1, "a", "b"), (1, "a", "b")), make((1, "c", "d"), (1, "c", "d"))) == 1
    assert differ(make((1, None, "a")), make((1, "a", None))) == 1
    assert differ(make((1, None, None)), make((1, None, None))) == 0
    lost = make((None, "a", "b"))
    assert rows(replay.replay_by_ranges(lost, lost, ["k"], ["v", "w"])) == rows(quality.replay_difference(lost, lost, ["k"], ["v", "w"]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_sketches_keep_to_their_error_and_merge_like_one(spark, folder):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey")
    for columns in (["l_orderkey"], ["l_partkey", "l_suppkey"]):
        at = f"{folder}/{columns[0]}"
        sketches.distinct_sketches(lines, ["l_returnflag"], columns).write.parquet(at)
        stored = spark.read.parquet(at)
        exact = {r[0]: r[1] for r in sketches.exact_distinct(lines, ["l_returnflag"], columns).collect()}
        told = {r.l_returnflag: r.n_distinct for r in sketches.estimates(stored).collect()}
        assert exact.keys() == told.keys() and all(abs(told[k] - n) <= 3 * sketches.STANDARD_ERROR * n + 1 for k, n in exact.items())
        whole = lines.select(*columns).distinct().count()
        assert sketches.exact_distinct(lines, [], columns).first()[0] == whole
        merged = sketches.estimates(sketches.merge_sketches(stored)).first()[0]
        assert abs(merged - whole) <= 3 * sketches.STANDARD_ERROR * whole + 1


def test_sketches_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("a", 1, 2), (None, None, 3)], "g string, x long, y long")
    exact = sketches.exact_distinct(df, ["g"], ["x", "y"])
    assert set(map(tuple, exact.collect())) == {("a", 1), (None, 0)}
    assert set(map(tuple, sketches.estimates(sketches.distinct_sketches(df, ["g"], ["x", "y"])).collect())) == {("a", 1), (None, 0)}
    assert sketches.distinct_sketches(df.limit(0), ["g"], ["x"]).count() == 0
