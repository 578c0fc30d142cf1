import base64
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken

from kalibra.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, n_tokens string, block string"


def own(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpacked(ids):
    return np.frombuffer(ids, dtype="<u4").tolist()


def encoded(ranks, text):
    return [i for ids in ranks.replay([w.encode() for w in regex.findall(PATTERN, text)]) for i in unpacked(ids)]


def various():
    ranks = bpe.Ranks(PATH)
    rng = random.Random(4)
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(sorted(ranks.rank), 3000)]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts += ["", "a" * 5000, "aab" * 700, "日本語テスト 🙂", "it's  \n\n 12345", "\x00\x1c", "ééé" * 400]
    texts += ["".join(rng.choice("ab ") for _ in range(60)) for _ in range(100)]
    texts += ["".join(rng.choice(["a", "b", "'s", "1", ",", " ", "\n", " ", "\x1c", "　"][: rng.randrange(5, 11)]) for _ in range(30)) for _ in range(300)]
    return texts


def test_replay_equals_library():
    ranks = bpe.Ranks(PATH)
    library = own(ranks.rank)
    for text in various():
        assert encoded(ranks, text) == library.encode_ordinary(text)


def test_operator_equals_library(spark, monkeypatch):
    """Many blocks and parts, texts with and without odd white space, both ways of cutting."""
    monkeypatch.setattr(bpe, "PART_BYTES", 5000)
    library = own(bpe.Ranks(PATH).rank)
    rows = [(n, t, "x", "y", "z") for n, t in enumerate([*various(), None, "long words and so on, " * 5_000])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for cut in (True, False):
        got = {r.doc_id: unpacked(r.ids) for r in bpe.encode(df, PATH, PATTERN, blanks_cut=cut).collect()}
        assert got == {r[0]: library.encode_ordinary(r[1] or "") for r in rows}


def test_blocks_have_their_own_numbers(spark):
    rows = [(n, f"word{n % 7} and {n} more", "x", "y", "z") for n in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    whole = bpe.split_words(df, PATTERN, 3, True, "doc_id", "text")
    assert whole.select("block").distinct().count() == 1
    assert {p.part for p in whole.where("part is not null").collect()} == {0, 1, 2}


def test_ranks_that_are_not_monotone(tmp_path):
    """Tokens that merges can reach before their parts have lower ranks."""
    rng = random.Random(6)
    for trial in range(30):
        tokens = [bytes([b]) for b in range(256)]
        more = list({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(14)})
        rng.shuffle(more)
        path = tmp_path / f"{trial}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % n for n, t in enumerate(tokens + more)))
        ranks = bpe.Ranks(str(path))
        library = own(ranks.rank)
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        assert [encoded(ranks, t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_round_trip(spark):
    rows = [(1, "Hello wörld\n", "x", "y", "z"), (2, None, "x", "y", "z"), (3, "", "x", "y", "z"), (1, "Hello wörld\n", "x", "y", "z"), (None, "z " * 9000, "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = bpe.decode(bpe.encode(df, PATH, PATTERN, blanks_cut=True), PATH).collect()
    assert sorted((bytes(r.decoded).decode() for r in got)) == sorted((r[1] or "") for r in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    both = bpe.encode(df, PATH, PATTERN, decoded=True).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, got))
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
