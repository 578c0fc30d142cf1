import itertools
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.llm import language_model as lm
from kalibra.llm import numbers, queries
from kalibra.llm.words import WORD, ascii_lower

SCHEMA = "doc_id long, text string, score string, block string"


def small_model():
    rng = np.random.default_rng(0)
    shares = rng.random(lm.CLASSES)
    return lm.Hmm.initial(shares / shares.sum())


def test_numbers_round_trip():
    for n in ([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 2], []):
        assert numbers.unpacked(numbers.packed(np.array(n, dtype=np.int64))).tolist() == n
    rng = np.random.default_rng(1)
    own = numbers.numbering()
    seen = np.array([own[int(x)] + 5 if x > 20 else int(x) % 5 for x in rng.integers(0, 90, 500)])
    assert numbers.unpacked_firsts(numbers.packed_firsts(seen, 5), 5).tolist() == seen.tolist()
    hashes = rng.integers(0, 2**63, 50).astype(np.uint64)
    assert {int(i): p for p, own in numbers.parts_of(hashes, 7) for i in own} == {i: int(h) % 7 for i, h in enumerate(hashes)}


def test_forward_equals_sum_over_paths():
    m = small_model()
    for seen in ([3], [3, 7, 7], [1, 2, 3, 254]):
        total = 0.0
        for path in itertools.product(range(lm.STATES), repeat=len(seen)):
            p = m.start[path[0]] * m.emit[path[0], seen[0]]
            for a, b, c in zip(path, path[1:], seen[1:]):
                p *= m.move[a, b] * m.emit[b, c]
            total += p
        both = m.log10([np.array(seen, dtype=np.uint8), np.array([5], dtype=np.uint8)])
        assert both[0] == pytest.approx(math.log10(total), abs=1e-9)


def test_counts_equal_posteriors_over_paths_and_padding_counts_nothing():
    m = small_model()
    seen = [3, 9, 254]
    emit, move = np.zeros((lm.STATES, lm.CLASSES)), np.zeros((lm.STATES, lm.STATES))
    weights = {}
    for path in itertools.product(range(lm.STATES), repeat=3):
        p = m.start[path[0]] * m.emit[path[0], seen[0]]
        for a, b, c in zip(path, path[1:], seen[1:]):
            p *= m.move[a, b] * m.emit[b, c]
        weights[path] = p
    whole = sum(weights.values())
    for path, p in weights.items():
        for s, c in zip(path, seen):
            emit[s, c] += p / whole
        for a, b in zip(path, path[1:]):
            move[a, b] += p / whole
    rows = lambda *texts: (lm.padded([r for t in texts for r, _ in lm.segments(np.array(t[:-1]))]), np.array([f for t in texts for _, f in lm.segments(np.array(t[:-1]))]))
    got = m.counts(*rows(seen, [1] * 5 + [254])) - m.counts(*rows([1] * 5 + [254]))
    first = np.zeros(lm.STATES)
    for path, p in weights.items():
        first[path[0]] += p / whole
    assert np.allclose(got[: lm.STATES], first)
    assert np.allclose(got[lm.STATES : lm.STATES + lm.STATES**2].reshape(lm.STATES, -1), move)
    assert np.allclose(got[lm.STATES + lm.STATES**2 :].reshape(lm.STATES, -1), emit)


def test_base_by_brute_force_and_model_beats_it(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    tokens = {i: [*WORD.findall(ascii_lower(t or "")), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    got = queries.op7_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), abs=1e-6)
    mean = lambda f: sum(f(r) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    print(mean(lambda r: r.base_score), mean(lambda r: r.score))
    assert mean(lambda r: r.score) > mean(lambda r: r.base_score) + 0.05
    # Where every word is known, the unknown word's share plays no part: what is won is won by the states.
    known = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert len(known) > 10 and all(r.score > r.base_score for r in known)
    assert sum(r.score - r.base_score for r in known) > 0.1 * sum(r.n_tokens for r in known)


def test_edges(spark):
    rows = [(i, "a b c", "x", "y") for i in range(20)] + [(30, None, "x", "y"), (31, "", "x", "y"), (32, "Zz " * 30000, "x", "y"), (None, "a", "x", "y"), (1, "a b c", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(df, F.col("doc_id") < 10, iterations=1).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (30, 31)} == {1}
    assert all(math.isfinite(r.score + r.base_score) for r in lm.score(df, F.lit(False), iterations=1).collect())
    assert lm.score(df.limit(0), F.lit(True), iterations=1).count() == 0


def test_long_texts_count_every_token_and_move_once():
    """Segments against the exact recursion over the whole text."""
    m = small_model()
    rng = np.random.default_rng(5)
    text = rng.integers(0, 250, 3 * lm.SEGMENT + 40)
    whole = np.append(text, lm.END)
    alpha, beta = np.zeros((len(whole), lm.STATES)), np.ones((len(whole), lm.STATES))
    for t, c in enumerate(whole):
        alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * m.by_class[c]
        alpha[t] /= alpha[t].sum()
    for t in range(len(whole) - 2, -1, -1):
        beta[t] = m.move @ (m.by_class[whole[t + 1]] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    moves = np.zeros((lm.STATES, lm.STATES))
    for t in range(len(whole) - 1):
        xi = alpha[t][:, None] * m.move * (m.by_class[whole[t + 1]] * beta[t + 1])
        moves += xi / xi.sum()
    rows, first = zip(*lm.segments(text))
    got = m.counts(lm.padded(rows), np.array(first))
    assert got[: lm.STATES].sum() == pytest.approx(1) and got[lm.STATES : lm.STATES + lm.STATES**2].sum() == pytest.approx(len(whole) - 1)
    assert np.allclose(got[lm.STATES : lm.STATES + lm.STATES**2].reshape(lm.STATES, -1), moves, rtol=0.03, atol=0.03)
    emitted = got[lm.STATES + lm.STATES**2 :].reshape(lm.STATES, -1)
    assert emitted.sum() == pytest.approx(len(whole)) and np.allclose(emitted.sum(axis=1), gamma.sum(axis=0), rtol=0.02)


def test_one_very_long_text_beside_others():
    m = small_model()
    texts = [np.full(n, 7, dtype=np.uint8) for n in [3] * 300 + [400_000]]
    together = m.log10(texts)
    assert together[:300] == pytest.approx(np.full(300, m.log10(texts[:1])[0])) and together[300] < together[0]
    assert lm.padded(texts[:2]).dtype == np.uint16


def test_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 200)
    rows = [(i, f"a b{i % 3} c{i}", "x", "y") for i in range(90)]
    got = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(6), F.lit(True), iterations=1).collect()
    count = Counter(w for _, t, *_ in rows for w in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    for r in got:
        own = [*rows[r.doc_id][1].split(), None]
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
