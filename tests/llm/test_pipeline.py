import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from kalibra.llm import lines, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    english, french = "the of and to in that is was for with".split(), "le la de et les des une dans pour que".split()

    def body(lang, n=60):
        return "\n".join(" ".join(rng.choice(english if lang == "en" else french) + str(rng.randrange(30)) * (k % 3 == 0) for k in range(10)) for _ in range(n // 10))

    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        rows.append((i, body(lang) + ("\nShared footer line" if i % 4 == 0 else ""), lang, f"s{i % 3}"))
    rows += [(100 + k, rows[5][1], "en", "s1") for k in range(4)]  # copies
    rows += [(200, "too short", "en", "s1"), (201, None, "en", "s1"), (202, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21", None, "s2"), (203, "same words again and again ok now " * 30, "en", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    docs, seen = spark.read.parquet(path), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()

    good = {r[0] for r in rows if (m := quality.measure(r[1]))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r.doc_id for r in seen["quality_rules"]} == good
    assert {r.doc_id for r in seen["language_id"]} == good - {202}

    before = {r.doc_id: r.text for r in seen["language_id"]}
    often = Counter(k for t in before.values() for k in {*lines.keys_of(t, 1)} if k)
    first = {k: min(i for i, t in before.items() if k in lines.keys_of(t, 1)) for k, n in often.items() if n >= 10}
    for r in seen["line_dedup"]:
        kept, met = [], set()
        for line, k in zip(before[r.doc_id].split("\n"), lines.keys_of(before[r.doc_id], 1), strict=True):
            if k not in first or first[k] == r.doc_id and k not in met:
                kept.append(line)
            met.add(k)
        assert r.text == "\n".join(kept) and r.n_chars == len(r.text)

    assert {r.doc_id for r in seen["near_dedup"]} == {r.doc_id for r in seen["line_dedup"]} - {100, 101, 102, 103}
    whole, spans = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in seen["packing"]:
        spans[r.doc_id].append((r.start, r.length))
    for r in seen["near_dedup"]:
        n = len(whole.encode(r.text, add_special_tokens=False).ids) + 1
        at = 0
        for start, length in sorted(spans[r.doc_id]):
            assert start == at
            at += length
        assert at == n
    assert sorted((r.doc_id, r.start) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.start) for r in seen["packing"])


WIDE = SCHEMA + ", row string, text_ string, kept string, host string, component_id string"


def through(spark, rows, path):
    """What each stage returns for the rows; columns with names of the operators' own."""
    docs, seen = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], WIDE), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{path}/{n}")
        docs = spark.read.parquet(f"{path}/{n}")
        assert name == "packing" or docs.columns == [c.split()[0] for c in WIDE.split(", ")]
        seen[name] = docs.collect()
    return seen


def test_stages_of_an_empty_table(spark, tmp_path):
    assert not any(through(spark, [], tmp_path).values())


def test_stages_with_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = corpus()
    long_ = "\n".join(f"of the {i} and {i * i} with that" for i in range(60_000))
    rows += [(300, long_, "en", "s1", len(long_)), (301, "", "en", None, 0), (None, None, None, None, None), (None, rows[7][1] + " once", "en", None, 5)]
    rows += [(302, rows[9][1] + " twice over " * 9, "en", "s1", 7)] * 2 + [(None, rows[9][1] + " three of them " * 6, "en", "s1", 7)] * 2
    seen = through(spark, rows, tmp_path)
    ids = {name: Counter(r.doc_id for r in found) for name, found in seen.items()}
    for name in ("quality_rules", "language_id", "line_dedup", "near_dedup"):
        assert 301 not in ids[name] and ids[name][302] == (0 if name == "near_dedup" else 2) and ids[name][300] == 1 and ids[name][None] == 3  # 302 is a near copy of 9
    assert next(r for r in seen["near_dedup"] if r.doc_id == 300).text == long_
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["near_dedup"])
    assert sum(r.length for r in seen["packing"]) == want
