"""Splitting joins against plain ones, with one key in a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join(spark, how):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 20)}", "f") for i in range(3000)], "id long, key string, field string")
    facts = spark.createDataFrame([("hot", "f", 1), ("k3", "f", 2), ("k4", "g", 3), ("none", "f", 4)], "key string, field string, x int")
    counts = rows.groupBy("key", "field").agg(F.count("*").alias("n"))
    heavy = skew.heavy_keys(counts, ["key", "field"], 100)
    assert heavy.count() >= 1 and skew.heavy_keys(counts, ["key", "field"]) is None
    got = skew.split_join(rows, facts, ["key", "field"], heavy, "id", how)
    want = rows.join(facts, ["key", "field"], how)
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=str) == sorted(map(tuple, want.select(sorted(want.columns)).collect()), key=str)
    dealt = skew._dealt(rows, ["key", "field"], heavy, F.col("id")).where("key = 'hot'").groupBy("__part").count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 200
    assert skew.split_join(rows.where("false"), facts, ["key", "field"], heavy, "id").count() == 0


@pytest.mark.parametrize("piece", [7, 1000])
def test_row_pairs(spark, piece):
    rows = [("a", i) for i in range(60)] + [("b", 100 + i) for i in range(25)] + [("c", 200), ("c", 200), ("d", 300)]
    pairs = [("a", "b"), ("a", "c"), ("c", "d"), ("d", "zz")]
    members = spark.createDataFrame(rows, "key string, id long")
    heavy = skew.heavy_keys(members.groupBy("key").agg(F.count("*").alias("n")), ["key"], piece)
    assert (heavy is None) == (piece == 1000)
    got = skew.row_pairs(spark.createDataFrame(pairs, "a string, b string"), members, heavy)
    want = sorted((x, y, i, j) for x, y in pairs for k, i in rows if k == x for m, j in rows if m == y)
    assert sorted(map(tuple, got.collect())) == want
