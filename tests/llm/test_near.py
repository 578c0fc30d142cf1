import random
import re

import numpy as np

from kalibra.llm import near
from kalibra.llm.components import components

SCHEMA = "doc_id long, text string, node string, component_id string, label string"


def brute(rows, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)), key=lambda n: rows[n][0])
                root[b] = a
    return {rows[x][0]: (len(sets[x]), rows[find(x)][0]) for x in range(len(rows))}


def corpus(rng, bases=12, copies=15, words=80):
    out = []
    for b in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        out.append(base)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            out.append(own)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def check(spark, rows, percent, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = near.near_duplicates(df, percent=percent, **more).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_equals_brute_force(spark):
    rows = corpus(random.Random(1))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "one two"), (504, "ONE two"), (505, "one two three"), (506, "a b c d e"), (507, "long " * 20000), (508, "long " * 20001)]
    check(spark, rows, 85)


def test_large_nodes_branch_on(spark):
    check(spark, corpus(random.Random(2), bases=3, copies=40), 80, leaf=6)


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = near.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 2 + [("None", "None", True)] * 2
    assert near.near_duplicates(df.limit(0)).count() == 0
    assert near.keep_one(df).columns == df.columns and near.keep_one(df).count() == 4


def test_one_id_over_several_sets(spark):
    """Rows that share an id are one document: it links the sets of its texts, also where neither is named after it."""
    a, b, c = ("a b c d e f", "g h i j k l", "m n o p q r")
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (21, c), (21, "s t u v w x"), (21, "s t u v w y"), (4, "lone words of its own here"), (7, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(df, percent=85).collect())
    assert got == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False), (20, 20, True), (21, 20, False), (21, 20, False), (21, 20, False)]
    assert sorted(r.doc_id for r in near.keep_one(df, percent=85).collect()) == [3, 4, 7, 20]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(90, 139)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 1 for i in range(2, 31)}, **{i: 90 for i in range(100, 140)}}


def test_pairs_at_the_threshold_inside_a_crowd(spark):
    """250 pairs of similarity 0.8 exactly, all of one template: 0.71 alike, so that nodes shrink slowly over the levels."""
    rng = random.Random(5)
    word = lambda: f"x{rng.randrange(10**9)}"
    template = [word() for _ in range(101)]
    rows = []
    for _ in range(250):
        own = [word() for _ in range(20)]
        rows += [template + own, template + own[:7] + [word() for _ in range(13)]]
    assert near.ceil(2 * len(rows) / 6) > near.trees_for(80, 1)  # one level of trees, then tiles
    check(spark, [(i, " ".join(w)) for i, w in enumerate(rows)], 80, leaf=6)


def test_tiles_hold_every_pair(spark):
    sets = spark.range(60).withColumnRenamed("id", "node")
    together = {}
    for r in near.tiles(sets, 7).collect():
        together.setdefault(r.key, set()).add(r.node)
    assert all(any({a, b} <= t for t in together.values()) for a in range(60) for b in range(a))


def test_chance_to_miss_a_pair_over_the_levels():
    for percent in (80, 85):
        chances = [near.missed(percent, near.DEPTH + near.DEEPER * n, near.trees_for(percent, n)) for n in range(5)]
        assert sum(chances) < 2 * near.MISSED
    rng, trees, depth = np.random.default_rng(1), 12, near.DEPTH + near.DEEPER
    a = rng.integers(0, 256, (4000, near.TOKENS)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
    lost = ~(near.walks(a, trees, depth, 1) == near.walks(b, trees, depth, 1)).any(axis=1)
    assert abs(lost.mean() - near.missed(80, depth, trees)) < 0.03


def test_nodes_choose_the_tokens_of_a_path():
    """Within one tree, sets that part at the root look at different tokens afterwards."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (300, near.TOKENS)).astype(np.uint8)
    first = near.walks(a, 1, 1, 0)[:, 0]
    chosen = {int((f >> np.uint64(32)) % np.uint64(near.TOKENS)) for f in first}
    assert len(set(first.tolist())) > 100 and len(chosen) > 50
    assert len(np.unique(near.walks(a[:1], 60, near.DEPTH, 0))) == 60


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.82 to 0.88, each a group of its own, against brute force."""
    rng = random.Random(11)
    rows = []
    for n in range(500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]  # 100 shingles
        near_ = base[: 104 - rng.randrange(6, 11)]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(near_ + [f"y{rng.randrange(10**6)}" for _ in range(104 - len(near_))]))]
    want = brute(rows, 85)
    linked = {i for i, (_, c) in want.items() if c != i}
    assert 100 < len(linked) < 400
    got = near.near_duplicates(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), percent=85).collect()
    found = {r.doc_id for r in got if r.component_id != r.doc_id}
    print("recall", len(found & linked) / len(linked))
    assert len(found & linked) >= 0.99 * len(linked) and not found - linked


def test_long_texts_are_dealt_out(spark, monkeypatch):
    """Nodes of more shingles than a group may hold: their pairs and tiles apart, with the same result."""
    monkeypatch.setattr(near, "UNIT", 300)
    check(spark, corpus(random.Random(7), bases=4, copies=20), 85)
    check(spark, corpus(random.Random(8), bases=2, copies=25), 80, leaf=6)


def test_estimates_drop_few_pairs_at_the_threshold():
    for percent in (80, 85):
        p = percent / 100 + (1 - percent / 100) / 256
        low = [n for n in range(near.TOKENS + 1) if near.agreement(np.arange(near.TOKENS) < n, np.ones((1, near.TOKENS), dtype=bool))[0] < percent / 100 - near.MARGIN]
        assert sum(near.comb(near.TOKENS, n) * p**n * (1 - p) ** (near.TOKENS - n) for n in low) < 3e-6
