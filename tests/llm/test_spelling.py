import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from kalibra.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n long"


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least=6, times=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    forms, near = {}, {}
    for w, n in words.items():
        own = [v for v in words if distance_one(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        near[w] = len(own)
        forms[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), n, near[w], words.get(forms[w])) for w, n in words.items()}


def brute_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    stems = ["organise", "organize", "colour", "color", "Straße", "éclair", "cafétéria", "window", "letter", "aaaaaa", "aaaaaaa"] + ["ment" + "".join(rng.choice("abé") for _ in range(rng.randrange(2, 6))) for _ in range(60)]

    def typo(w):
        k = rng.randrange(len(w))
        return w[:k] + rng.choice(["", rng.choice("abcé"), w[k] + "x"]) + w[k + 1 :] if rng.random() < 0.2 else w

    rows = [(i, " ".join(typo(rng.choice(stems[: rng.randrange(1, len(stems))])) for _ in range(rng.randrange(120)))) for i in range(150)]
    return rows + [(None, "organise " * 9), (None, None), (900, None), (901, ""), (3, "letter lettér LETTER " * 300), (902, "z" * 100_000 + " " + "x1" * 20_000), (903, "chained " * 130 + "chainedd " * 26 + "chaineddd " * 5)]


@pytest.mark.parametrize("shard", [spelling.SHARD, 7])
def test_variants_equal_brute_force(spark, shard):
    rows = corpus()
    counts = spelling.word_counts(spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA))
    expected = brute_counts(rows)
    expected.pop("", None)
    assert {r.word: r.n for r in counts.collect()} == expected
    words = counts.where("length(word) >= 6 and n >= 5").select("word", "n")
    near = {(r.word, r.n_near) for r in spelling.neighbours(words, shard=shard).collect()}
    by_hand = brute(expected)
    assert near == {(w, k) for w, _, _, _, k, _ in by_hand}
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(counts).collect()} == by_hand


def test_query_equals_sql(spark, tmp_path):
    rows = corpus(seed=9)
    spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    got = {tuple(r[n] for n in names) for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op13_spelling_variants']})").fetchall())
    assert any(t[1] for t in got) and any(t[2] != t[1] and t[1] for t in got)


def test_forms_are_followed_to_their_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w7")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {*((f"w{i}", "w20") for i in range(20)), ("x", "w20")}


def test_all_words_under_one_half(spark):
    """Hundreds of words that share a half: found by the halves of what is left, counted right."""
    words = {"abcdef" + "".join(c) for c in [(a, b, c) for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"]}
    frame = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    assert {r.n_near for r in spelling.neighbours(frame, shard=50).collect()} == {18}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    with pytest.raises(ValueError, match="letters"):
        spelling.variants(spelling.word_counts(empty), min_length=3)
