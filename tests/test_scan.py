"""The scan with carry against the window it stands for, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise.operators.scan import running


def both(df, parts):
    w = Window.partitionBy("k", "g").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    scan = running(df, ["k", "g"], ["at"], {"total": F.col("v") * 2, "n": F.lit(1)}, {"seen": F.col("s")}, parts)
    window = df.select("*", F.sum(F.col("v") * 2).over(w).alias("total"), F.sum(F.lit(1)).over(w).alias("n"),
                       F.last("s", ignorenulls=True).over(w).alias("seen"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    return order(scan.collect()), order(window.collect())


def test_scan_equals_window_for_hot_null_and_single_keys(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 6 + ["a", "b", None]), draw.choice([1, 1, None]), i, draw.choice([None, 1, -5, 7]), draw.choice([None, None, "x", "y"]))
            for i in range(700)]
    df = spark.createDataFrame(rows, "k string, g int, at int, v bigint, s string")
    for parts in (1, 7, 40):
        got, want = both(df, parts)
        assert got == want
    got, want = both(df.filter("k = 'hot' AND g = 1"), 9)
    assert got == want and len(got) > 200
    assert running(df.limit(0), ["k"], ["at"], {"n": F.lit(1)}).collect() == []


def test_scan_splits_a_hot_key_over_partitions(spark):
    df = spark.range(20_000).select((F.col("id") % 3 > 0).cast("int").alias("k"), "id")
    out = running(df, ["k"], ["id"], {"n": F.lit(1)}, num_partitions=20)
    sizes = [r["c"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    assert sum(sizes) == 20_000
    local = [line for line in out._jdf.queryExecution().toString().splitlines() if "Window [" in line and "_scan" in line]
    assert local and all("_scanpart" in line for line in local if "specifiedwindowframe" in line)
    assert {r["k"]: r["n"] for r in out.groupBy("k").agg(F.max("n").alias("n")).collect()} == {0: 6667, 1: 13333}


def test_scan_refuses_a_name_that_is_there(spark):
    try:
        running(spark.range(3).withColumn("_scan", F.lit(1)), ["id"], ["id"], {"ID": F.lit(1)})
    except ValueError as e:
        assert "ID" in str(e)
    else:
        raise AssertionError("a column would have been replaced")
