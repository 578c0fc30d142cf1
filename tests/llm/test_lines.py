import itertools
import random
from collections import defaultdict

import numpy as np

from kalibra.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, row long"


def brute(rows, min_docs, keep_first):
    docs = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for k in lines.keys_of(t, 1):
            docs[k].add(n)
    out = []
    for n, (i, t) in enumerate(rows):
        kept, seen = [], set()
        for line, k in zip((t or "").split("\n"), lines.keys_of(t, 1), strict=True):
            often = k is not None and len(docs[k]) >= min_docs
            first = keep_first and k not in seen and n == min(docs[k], key=lambda m: (rows[m][0] is None, rows[m][0])) if often else False
            seen.add(k)
            if not often or first:
                kept.append(line)
        out.append((i, "\n".join(kept), (t or "").count("\n") + 1))
    return sorted(out, key=repr)


def data():
    rng = random.Random(5)
    pool = ["Alpha beta", " alpha BETA\t", "Ünder", "ünder", "x" * 5000, "", "  ", "\x1c", "once"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randrange(12)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (None, "Alpha beta\nlast")]


def test_equals_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    for keep_first, bits, small in itertools.product((False, True), (None, 12, 4), (0, lines.SMALL)):  # 2**4 bits: a filter that holds everything
        got = lines.drop_repeated(df, min_docs=3, keep_first=keep_first, bits=bits, small=small).collect()
        assert sorted(((r.doc.doc_id, r.text, r.n_lines) for r in got), key=repr) == brute(rows, 3, keep_first)
        assert all(r.n_dropped == r.n_lines - (r.text.count("\n") + 1) or not r.text for r in got)


def test_many_tasks_merge(spark):
    rows = [(i, f"common\nown {i}", "x", 1) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(70)
    assert df.rdd.getNumPartitions() > lines.FAN_IN
    assert {r.text for r in lines.drop_repeated(df, min_docs=70).collect()} == {f"own {i}" for i in range(70)}


def test_documents_without_a_suspect_are_not_shuffled(spark):
    """Of the texts only those with a suspected line meet an exchange, and with few confirmed keys none."""
    df = spark.createDataFrame([(*r, "x", 1) for r in data()], SCHEMA)
    plan = lambda small: lines.drop_repeated(df, min_docs=3, small=small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(lines.SMALL) and "Union" in plan(0) and "Join" in plan(0)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb", "x", 1)] * 3 + [(2, "c", "x", 1)], SCHEMA)
    assert sorted(r.text for r in lines.drop_repeated(df, min_docs=3).collect()) == ["", "", "", "c"]
    assert lines.drop_repeated(df.limit(0), min_docs=3).count() == 0


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = lines.Seen(14), lines.Seen(14)
    a.add(hashes[:200])
    a.add(hashes[100:150])
    b.add(hashes[190:])
    assert lines.Seen.holds(a.twice, a.places(hashes[100:150])).all()
    twice = a.twice | b.twice | (a.once & b.once)
    assert lines.Seen.holds(twice, a.places(hashes[190:200])).all()
