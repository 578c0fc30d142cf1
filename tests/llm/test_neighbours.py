import numpy as np
from pyspark.sql import functions as F

from kalibra.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[50:150] = data[50]  # ties
    rows = [(i, v.tolist(), "", "") for i, v in enumerate(data)]
    rows += [(400, None, "", ""), (420, [0.0] * 8, "", ""), (440, [float("nan")] * 8, "", ""), (460, [None] * 8, "", ""), (480, [], "", ""), (500, [float("inf")] * 8, "", ""), (None, [1.0] * 8, "", "")]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, block=64, query_block=4).collect()
    assert {r.query_id for r in got} == set(range(0, 300, 20))
    wide = data.astype(np.float64)
    for q in range(0, 300, 20):
        scores = neighbours.inner(np.broadcast_to(wide[q], wide.shape), wide)
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, scores[i]) for i in order]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [0.5, 0.5], "", ""), (20, [1.0, 1.0, 1.0], "", "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_queries_and_candidates(spark):
    """Of a repeated query the smallest vector asks; repeated candidates answer each; doubles stay doubles."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.1, 0.0]), (None, [9.0, 9.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, block=2).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 2, 0.1)]


def test_many_dimensions(spark):
    """Above the dimensions that float32 holds exactly, bounds still hold."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, neighbours.EXACT + 60))
    heaps = neighbours.tile(np.arange(3), data[:3], np.arange(60), data, 5)
    for q in range(3):
        scores = neighbours.inner(np.broadcast_to(data[q], data.shape), data)
        want = [i for i in np.lexsort((np.arange(60), -scores)) if i != q][:5]
        assert [-v for _, v in sorted(heaps[q], key=lambda h: (-h[0], -h[1]))] == want
