"""Running values with a key of most rows, cut into many pieces, against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kalibra.operators import scan

SCHEMA = "k string, t long, i long, v long"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    keys = ["hot"] * 60 + ["warm"] * 10 + [f"k{n}" for n in range(30)] + [None] * 5
    made = [(rng.choice(keys), rng.randrange(300), i, rng.choice([None, None, None, rng.randrange(50)])) for i in range(4000)]
    return spark.createDataFrame(made, SCHEMA).repartition(5).cache()


def both(df, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


@pytest.mark.parametrize(("most", "parts"), [(100, 16), (100, 3), (10_000, None)])
def test_running_values_equal_windows(rows, most, parts):
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, above, below = w.rowsBetween(scan.FIRST, 0), w.rowsBetween(scan.FIRST, -1), w.rowsBetween(1, scan.LAST)
    v = F.col("v")
    expected = rows.select(
        "i", F.last("v", ignorenulls=True).over(upto).alias("last"), F.last("v", ignorenulls=True).over(above).alias("before"), F.first("v", ignorenulls=True).over(below).alias("after"),
        F.sum(F.coalesce(v, F.lit(0))).over(upto).alias("total"), F.max("v").over(above).alias("highest"), F.lag("v").over(w).alias("lag"),
    )
    ordered = scan.Ordered(rows, ["k"], ["t", "i"], most=most, parts=parts)
    assert ordered.cut == (most == 100)
    got = ordered.with_running({"last": scan.last(v), "before": scan.before(v), "after": scan.after(v), "total": scan.total(v), "highest": scan.highest_before(v), "row": scan.before(F.struct("v"))})
    columns = ["i", "last", "before", "after", "total", "highest", "lag"]
    assert both(got.frame().withColumn("lag", F.col("row.v")), columns) == both(expected, columns)


@pytest.mark.parametrize("most", [100, 10_000])
def test_running_values_over_running_values(rows, most):
    ordered = scan.Ordered(rows, ["k"], ["t", "i"], most=most, parts=12).with_running({"previous": scan.before(F.col("t"))})
    got = scan.numbered_runs(ordered, F.col("t") - F.col("previous") > 1, "run")
    w = Window.partitionBy("k").orderBy("t", "i")
    opens = rows.withColumn("opens", F.coalesce(F.col("t") - F.lag("t").over(w) > 1, F.lit(True)).cast("long"))
    assert both(got, ["i", "run"]) == both(opens.withColumn("run", F.sum("opens").over(w.rowsBetween(scan.FIRST, 0))), ["i", "run"])


@pytest.mark.parametrize("most", [50, 10_000])
def test_intervals_of_a_hot_key(spark, rows, most):
    spans = rows.select("k", "t", (F.col("t") + F.col("i") % 2).alias("e")).where("t % 3 > 0")
    got = scan.merged_intervals(spans, ["k"], "t", "e", most=most, parts=9)
    expected = []
    for k, own in ((k, sorted((r.t, r.e) for r in spans.collect() if r.k == k)) for k in {r.k for r in rows.select("k").distinct().collect()}):
        runs = []
        for s, e in own:
            if runs and s <= runs[-1][1]:
                runs[-1][1], runs[-1][2] = max(e, runs[-1][1]), runs[-1][2] + 1
            else:
                runs.append([s, e, 1])
        expected += [(k, *r) for r in runs]
    assert both(got, ["k", "t", "e", "parts"]) == sorted(map(repr, expected))


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_frames_over_blocks(rows, block):
    got = scan.framed(rows, ["k"], ["t", "i"], lambda w: F.max("v").over(w), "near", 3, 1, block=block, most=100, parts=8)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(-3, 1)
    assert both(got, ["i", "near"]) == both(rows.withColumn("near", F.max("v").over(w)), ["i", "near"])


def test_a_hot_key_is_many_tasks_work(rows):
    ordered = scan.Ordered(rows, ["k"], ["t", "i"], most=100, parts=16)
    sizes = [r["count"] for r in ordered.rows.where("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scan.Ordered(none, ["k"], ["t"]).with_running({"x": scan.total(F.lit(1))}).frame().count() == 0
    assert scan.Ordered(none, ["k"], ["t"], most=-1, parts=3).with_running({"x": scan.total(F.lit(1)), "y": scan.after(F.col("v"))}).frame().count() == 0


@pytest.mark.parametrize("most", [2, 10_000])
def test_intervals_without_dates_come_last(spark, most):
    made = [("a", 1, 4), ("a", 3, 6), ("a", None, None), ("a", 9, 12), ("a", None, None), ("b", None, None), ("b", None, None), ("c", 5, 8), (None, 2, 3), (None, None, None)]
    spans = spark.createDataFrame(made, "k string, s int, e int").repartition(3)
    got = scan.merged_intervals(spans, ["k"], "s", "e", most=most, parts=5)
    expected = [("a", 1, 6, 2), ("a", 9, 12, 3), ("b", None, None, 1), ("b", None, None, 1), ("c", 5, 8, 1), (None, 2, 3, 2)]
    assert both(got, ["k", "s", "e", "parts"]) == sorted(map(repr, expected))


@pytest.mark.parametrize("most", [1, 10_000])
def test_nulls_of_an_order_come_last(spark, most):
    made = spark.createDataFrame([("a", None, 1, 7), ("a", 5, 2, 8), ("a", 3, 3, None), ("a", None, 4, None)], "k string, t long, i long, v long")
    got = scan.Ordered(made, ["k"], ["t", "i"], most=most, parts=3).with_running({"before": scan.before(F.col("v")), "after": scan.after(F.col("v"))}).frame()
    assert both(got, ["i", "before", "after"]) == sorted(map(repr, [(3, None, 8), (2, None, 7), (1, 8, None), (4, 7, None)]))
