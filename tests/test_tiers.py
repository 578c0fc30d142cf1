"""Exact, prefix and ending entries in one join, whatever their lengths."""

import random

from pyspark.sql import functions as F

from kalibra.operators import reconcile
from kalibra.plans import relational


def test_a_thousand_lengths_in_one_plan(spark):
    entries = [("a" * n, f"p{n}") for n in range(1, 1001)]
    endings = [("b" * n, f"s{n}") for n in range(1, 1001, 3)]
    texts = ["a" * 700 + "x", "b", "x" + "b" * 8, "a" * 1500, "", None, "c", "ab"] + ["c"] * 50
    frame = lambda rows: spark.createDataFrame(rows, "entry string, value string")
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = reconcile.tiered(left, "t", frame([("c", "exact"), ("a" * 1500, "long")]), frame(entries), F.lit("none"), frame(endings))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    got = [r.found for r in found.orderBy("i").collect()]
    assert got == ["p700", "s1", "s7", "long", "none", "none", "exact", "p1"] + ["exact"] * 50


def test_tiers_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
    exact, prefix, suffix = ({word(): f"{kind}{k}" for k in range(n)} for kind, n in (("e", 8), ("p", 8), ("s", 8)))
    texts = [word() for _ in range(300)]

    def plain(t):
        if t in exact:
            return exact[t]
        for table, piece in ((prefix, lambda n: t[:n]), (suffix, lambda n: t[len(t) - n :])):
            for n in range(len(t), 0, -1):
                if piece(n) in table:
                    return table[piece(n)]
        return "none"

    frame = lambda d: spark.createDataFrame(list(d.items()), "entry string, value string")
    left = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = reconcile.tiered(left, "t", frame(exact), frame(prefix), F.lit("none"), frame(suffix))
    assert [r.found for r in got.orderBy("i").collect()] == [plain(t) for t in texts]


def test_sets_of_a_million_values(spark):
    """The exact count and the smallest values of a key with a million of them; nulls and small keys beside it."""
    big = spark.range(1_000_000).select(F.lit("big").alias("k"), ((F.col("id") * 7) % 1_000_003).alias("v"))
    rows = big.unionByName(big.limit(10)).unionByName(spark.createDataFrame([("one", 5), ("one", 5), (None, 3), (None, None), ("none", None)], "k string, v long"))
    got = {r.k: (r.n, r.n_distinct, list(r["values"])) for r in reconcile.bounded_sets(rows, "k", "v", 5).collect()}
    smallest = sorted({7 * i % 1_000_003 for i in range(1_000_000)})[:5]
    assert got == {"big": (1_000_010, 1_000_000, smallest), "one": (2, 1, [5]), None: (2, 1, [3]), "none": (1, 0, [])}
    assert reconcile.bounded_sets(rows.limit(0), "k", "v", 5).count() == 0


def test_a_role_with_thousands_of_turns_keeps_them_all(spark, tmp_path):
    turns = spark.range(3000).select(F.lit("user").alias("role"), F.col("id").alias("turn"))
    few = spark.createDataFrame([("user", 7), ("user", None), ("system", None), (None, 2), (None, 1)], "role string, turn long")
    turns.unionByName(few).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.role: (r.n, r.n_turns, list(r.turns)) for r in relational.set_agg_roles(spark, str(tmp_path)).collect()}
    assert got == {"user": (3002, 3000, [*range(3000), None]), "system": (1, 0, [None]), None: (2, 2, [1, 2])}


def test_search_within_labels_meets_no_other_label(spark):
    """A hot label in several tiles, a null label, and a tile that holds vectors of one label only."""
    from kalibra.operators import match

    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    d = lambda a, b: 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(q, i, n + 1) for q, of, a in rows[::20] for n, (_, i) in enumerate(sorted((d(a, v), i) for i, x, v in rows if x == of and i != q)[:4])}
    got = match.nearest_in_tiles(df, F.col("vec_id") % 20 == 0, 4, within=True, block=16, query_block=2)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want
