"""Similar pairs and one-to-one matching against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from kalibra.operators import match, similar


def texts(n, seed):
    rng = random.Random(seed)
    stems = ["Engine speed limit", "engine  Speed threshold", "Coolant temperature", "boost pressure (max)", "idle torque reserve", "Ümlaut straße", "aaaa bbbb"]
    out = []
    for _ in range(n):
        t = list(rng.choice(stems) + rng.choice(["", " value", f" {rng.randrange(99)}"]))
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        out.append("".join(t))
    return out


def score(a, b):
    import difflib

    a, b = match.tidy(a), match.tidy(b)
    return 100.0 if not a and not b else round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 2)


def plain(left, right, threshold, bonus=lambda i, j: 0.0):
    pairs = sorted((-(s + bonus(i, j)), i, j, s) for i, a in left.items() for j, b in right.items() if (s := score(a, b)) >= threshold)
    used_i, used_j, out = set(), set(), set()
    for _, i, j, s in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.add((i, j, s))
    return out


def frames(spark, sides):
    made = []
    for key, side in zip(("left_id", "right_id"), sides, strict=True):
        made.append(spark.createDataFrame([(g, i, t, u) for g, i, t, u in side], f"g string, {key} long, text string, kind string"))
    return made


@pytest.mark.parametrize("threshold", [40.0, 70.0, 95.0, 100.0])
def test_pairs_equal_all_pairs(spark, threshold):
    left = dict(enumerate([*texts(60, 1), "", "  "]))
    right = dict(enumerate([*texts(60, 2), "", left[3]]))
    a, b = frames(spark, [[("x", i, t, None) for i, t in side.items()] for side in (left, right)])
    got = {tuple(r[c] for c in ("left_id", "right_id", "score")) for r in similar.similar_pairs(a, b, "g", threshold).collect()}
    assert got == {(i, j, s) for i, x in left.items() for j, y in right.items() if (s := score(x, y)) >= threshold}


def test_bound_is_over_the_score():
    from collections import Counter

    for a, b in zip(texts(300, 3), texts(300, 4), strict=True):
        assert similar.bound(Counter(match.tidy(a)), Counter(match.tidy(b))) >= score(a, b)


def test_few_pairs_are_scored():
    """Of 10,000 pairs those that come up: a tenth of all at most, with the greedy rows."""
    left, right = dict(enumerate(texts(100, 5))), dict(enumerate(texts(100, 6)))
    found, scored = similar.matched([(i, t, []) for i, t in left.items()], [(i, t, []) for i, t in right.items()], 70.0)
    assert {tuple(f) for f in found} == plain(left, right, 70.0)
    assert scored < 1000


@pytest.mark.parametrize("few", [0, 400, 1_000_000])
def test_matching_equals_plain_greedy(spark, few):
    """Groups through one task and through rounds, with ties, bonuses, repeated texts, nulls."""
    rng = random.Random(7)
    sides = []
    for seed in (8, 9):
        rows = []
        for n, g in enumerate(["hot"] * 50 + ["a"] * 15 + ["b"] * 5):
            rows.append((g, n, texts(1, seed * 1000 + n % 37)[0], rng.choice(["s", "t", "", None])))
        sides.append([*rows, (None, 900, "x", "s"), ("hot", 901, None, "s"), (f"only{seed}", 902, "y", None)])
    a, b = frames(spark, sides)
    got = {tuple(r[c] for c in ("g", "left_id", "right_id", "score")) for r in similar.one_to_one(a, b, "g", 60.0, bonuses={"kind": 1.5}, few=few).collect()}
    want = set()
    for g in ("hot", "a", "b"):
        own = [{i: t for h, i, t, _ in side if h == g and t is not None} for side in sides]
        kinds = [{i: k for h, i, _, k in side if h == g} for side in sides]
        want |= {(g, *p) for p in plain(*own, 60.0, lambda i, j, k=kinds: 1.5 if k[0][i] and k[0][i] == k[1][j] else 0.0)}
    assert got == want


@pytest.mark.parametrize("few", [3, 100_000])
def test_rounds_equal_sorted_greedy(spark, few):
    rng = random.Random(10)
    rows = [(rng.choice(["h", "h", "h", "k", None]), rng.randrange(30), rng.randrange(30), float(rng.randrange(40, 100)), rng.choice([0.0, 1.5])) for _ in range(900)]
    rows += [("chain", k, k + d, 50.0 + 2 * k + d, 0.0) for k in range(20) for d in (0, 1)] + [("h", None, 1, 99.0, 0.0)]
    got = match.greedy_pairs(spark.createDataFrame(rows, "g string, left_id long, right_id long, score double, bonus double"), "g", 50.0, few=few)
    used, want = set(), []
    for _, i, j, s, g in sorted(((-(s + b), i, j, s, g) for g, i, j, s, b in rows if s >= 50 and i is not None), key=lambda r: r[:4]):
        if (g, "l", i) not in used and (g, "r", j) not in used:
            used |= {(g, "l", i), (g, "r", j)}
            want.append((g, i, j, s))
    assert sorted(map(repr, (tuple(r) for r in got.select("g", "left_id", "right_id", "score").collect()))) == sorted(map(repr, want))


def test_no_texts(spark):
    none = spark.createDataFrame([], "g string, left_id long, text string")
    other = none.withColumnRenamed("left_id", "right_id")
    assert similar.one_to_one(none, other, "g", 70.0).count() == 0
    assert similar.similar_pairs(none, other, "g", 70.0).where(F.col("score") > 0).count() == 0
