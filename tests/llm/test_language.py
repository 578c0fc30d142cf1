import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def test_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_edges(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * (1 + i % 5), "en" if i % 2 else "fr", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "1234 !?", "fr", "x"), (103, "the mat " * 20000, None, "x"), (104, "\u00bd \u00b2 \u2462 \u2167 _ \u0301", "en", "x"), (None, "le chat", None, "x"), (1, rows[1][1], "en", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.train(df, F.lit(True))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102, 104)} == {"und"} and got[103].lang_pred == "en" and got[None].lang_pred == "fr"
    assert language.keep_known(df, model).columns == df.columns
    none = language.train(df.limit(0), F.lit(True))
    assert language.identify(df.limit(0), none).count() == 0
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


def test_elastic_net_leaves_weights_out():
    texts = ["aa bb cc" if i % 2 else "dd ee ff" for i in range(50)]
    model = language.fit(texts, ["x" if i % 2 else "y" for i in range(50)], np.ones(language.DIM), ["x", "y"])
    assert (model.weights != 0).any(axis=1).sum() < 60
    assert model.predict("bb cc")[0] == "x" and model.predict("ee ff")[0] == "y"


def test_ftrl_equals_a_plain_one():
    """Per-coordinate follow-the-regularised-leader, one number after the other."""
    rng = np.random.default_rng(3)
    rows = [(np.flatnonzero(rng.random(6) < 0.5), int(rng.integers(3))) for _ in range(40)]
    rows = [(at, rng.random(len(at)), label) for at, label in rows]
    own = language.Ftrl(6, 3)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, c):
        shrunk = max(abs(z[i][c]) - language.L1, 0.0)
        return -math.copysign(shrunk, z[i][c]) / ((language.BETA + math.sqrt(n[i][c])) / language.ALPHA + language.L2)

    for at, x, label in rows:
        own.learn(at, x, label)
        w = {(i, c): weight(i, c) for i in at for c in range(3)}
        scores = [math.exp(sum(v * w[i, c] for i, v in zip(at, x, strict=True))) for c in range(3)]
        for c in range(3):
            error = scores[c] / sum(scores) - (c == label)
            for i, v in zip(at, x, strict=True):
                g = v * error
                z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / language.ALPHA * w[i, c]
                n[i][c] += g * g
    assert np.allclose(own.weights(np.arange(7)), [[weight(i, c) for c in range(3)] for i in range(7)])


def test_tf_idf_by_counting():
    text = "Abab"
    grams = Counter(g for k in (1, 2, 3) for g in (f" {text.lower()} "[i : i + k] for i in range(len(text) + 3 - k)))
    at, tf = language.features(text)
    assert sorted(tf.tolist()) == pytest.approx(sorted(math.log1p(c) for c in grams.values()))
    _, x = language.weighted(at, tf, np.full(language.DIM, 2.0))
    assert (x**2).sum() == pytest.approx(1.0)


def test_ties_go_to_the_first_name():
    even = language.Model(["b", "c"], np.ones(language.DIM), np.zeros((language.DIM, 2)), np.zeros(2), 1.0)
    assert even.predict("word") == ("b", 0.5) and even.predict(None) == ("und", 0.0)
