import random
from collections import Counter

import duckdb

from kalibra.llm import quality, queries
from kalibra.llm.words import WORD

SCHEMA = "doc_id long, text string, source string, base_failed string, host string"


def brute_repeats(tokens):
    windows = [tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(hit)


def test_repeated_words_equals_brute_force():
    rng = random.Random(3)
    for n in [0, 7, 8, 9, 16, 40, 300]:
        for kinds in (1, 2, 5, 50):
            tokens = [str(rng.randrange(kinds)) for _ in range(n)]
            assert quality.repeated_words(tokens) == brute_repeats(tokens)


def test_measure_words_lines_symbols():
    text = "a b c\n#x\n#x\n \n \n\x1cq"
    n, chars, symbols, dups, _ = quality.measure(text)
    found = WORD.findall(text)
    assert (n, chars) == (len(found), sum(map(len, found)))
    assert (symbols, dups) == (2, 1)
    assert quality.measure(None) == quality.measure("") == (0, 0, 0, 0, 0)


def test_host_verdicts_shrink_and_join_back(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine", "x", "y") for i in range(40)]
    rows += [(100 + i, "too short", "bad", "x", "y") for i in range(39)] + [(139, good, "bad", "x", "y")]
    rows += [(200, "short", "tiny", None, None), (201, good, "tiny", None, None), (202, good, None, None, None), (None, None, None, None, None)]
    rows += [(202, good, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == set(range(40)) | {201, 202}
    assert next(r for r in got if r.doc_id == 139).base_failed is False
    left = quality.keep_good(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([*range(40), 201, 202, 202])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality.judge(df).count() == 0
    assert quality.keep_good(df).count() == 0


def test_query_joins_verdicts_back(spark, tmp_path):
    """A host of 40 % failures among hosts of 5 %: no majority, but far above the prior; one of few documents is spared."""
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(1000 * h + i, bad if i % 20 == 0 else good, f"h{h}") for h in range(12) for i in range(100)]
    rows += [(50_000 + i, bad if i % 5 < 2 else good, "worse") for i in range(200)] + [(60_000, bad, "tiny"), (60_001, good, "tiny"), (60_002, good, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, str(tmp_path)).collect()}
    assert {i for i, r in got.items() if r.kept != (not r.base_failed)} == {50_000 + i for i in range(200) if i % 5 >= 2}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.SQL["op3_quality_rules"])
    names = [d[0] for d in found.description]
    assert all(got[r[0]].asDict() == dict(zip(names, r, strict=True)) for r in found.fetchall())


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 400_000 + "\n" + "# " * 9, "s", "x", "y"), (2, " ".join(map(str, range(300_000))), "s", "x", "y")], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].base_failed) == (400_009, 1_600_009, 9, True)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].base_failed) == (300_000, 0, False)


def test_ties_at_the_limits(spark):
    twenty, nineteen = " ".join(map(str, range(20))), " ".join(map(str, range(19)))
    df = spark.createDataFrame([(1, twenty, None, "x", "y"), (2, nineteen, None, "x", "y")], SCHEMA)
    assert {r.doc_id: r.base_failed for r in quality.judge(df).collect()} == {1: False, 2: True}
