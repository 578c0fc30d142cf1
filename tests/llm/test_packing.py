import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kalibra.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's 'S x's", "", "a\x1cb c\x1d d", "ÉCOLE é İstanbul ΣΑΣ", "tab\tnew\nline nbsp x\x85y", "<|endoftext|> x<|endoftext|>y", "日本語 テスト 123 4٣5", " ́a", "word " * 5000, "x" * 3000, "🙂🙂 é#%*"]


def test_chunks_encode_as_whole_texts():
    whole = Tokenizer.from_file(PATH)
    encode = packing.ChunkEncoder(PATH).encode
    for text, ids in zip(TEXTS, encode(TEXTS), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts_of_the_corpus():
    whole = Tokenizer.from_file(PATH)
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    texts += [c + w + e for c in "ÀÿßıŉǅªµİŁ\u0130\u023a\u0251" for w in ("", "word", "Ωmega") for e in ("", ".,", "'s", "!?", "3")]
    encode = packing.ChunkEncoder(PATH).encode
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_level_minimises_sum_of_squares():
    rng = random.Random(1)
    windows = packing.Windows(50)
    closes = 50 - 50 // 16
    for n in range(400):
        size = rng.randrange(1, 50)
        before = int((windows.levels**2).sum())
        growth = {}
        for h in [0, *np.flatnonzero(windows.levels).tolist()]:
            if h + size <= 50:
                levels = windows.levels.copy()
                levels[h] -= h > 0
                levels[h + size] += h + size < closes
                growth[h] = int((levels**2).sum()) - before
        assert growth[windows.level_for(size)] == min(growth.values())
        best = min(growth.values())
        assert windows.level_for(size) == max(h for h, g in growth.items() if g == best)
        windows.add(n, bytes(4 * size))


def test_placements_equal_a_plain_packer():
    """Every placement, fill and cut by lists of window sizes, up to the end of the task."""
    rng = random.Random(2)
    windows, closes = packing.Windows(64), 64 - 64 // 16
    want, open_, short = [], [], None
    for n in range(600):
        size = left = rng.randrange(1, 150)
        windows.add(n, bytes(4 * size))
        if short:
            taken = min(left, 64 - sum(k for *_, k in short))
            short.append((n, 0, taken))
            left -= taken
            if sum(k for *_, k in short) == 64:
                want.append(short)
                short = None
        while left >= 64:
            want.append([(n, size - left, 64)])
            left -= 64
        if not left:
            continue
        sizes = Counter(sum(k for *_, k in w) for w in open_)
        cost = {}
        for h in {0, *sizes}:
            if h + left <= 64:
                after = Counter(sizes)
                after[h] -= h > 0
                after[h + left] += h + left < closes
                cost[h] = sum(v * v for v in after.values())
        h = max(h for h in cost if cost[h] == min(cost.values()))
        window = [] if not h else next(w for w in reversed(open_) if sum(k for *_, k in w) == h)
        open_ = [w for w in open_ if w is not window]
        window.append((n, size - left, left))
        if h + left == 64:
            want.append(window)
        elif h + left >= closes:
            short = window
        else:
            open_.append(window)
    assert [[(d, s, len(i) // 4) for d, s, i in w] for w in windows.full] == want


def test_most_windows_come_from_placing():
    """Tasks of 312 documents: what the end of a task cuts anew is under a tenth."""
    rng = random.Random(3)
    windows, ids = packing.Windows(2048), 0
    for n in range(312):
        size = min(20_000, int(rng.lognormvariate(6.3, 0.9)) + 1)
        ids += size
        windows.add(n, bytes(4 * size))
    placed = len(windows.full)
    windows.close()
    assert sum(len(p[2]) for w in windows.full for p in w) == 4 * ids and placed > 0.9 * ids / 2048


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert isinstance(packing.encoder(PATH), packing.ChunkEncoder) and isinstance(packing.encoder(path), packing.WholeEncoder)
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in packing.encoder(path).encode(TEXTS)] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_pieces_rebuild_documents(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 3)] + [(0, TEXTS[0], "x", "y"), (99, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, offset string").repartition(3)
    whole = Tokenizer.from_file(PATH)
    got = packing.with_checksum(packing.pack(df, PATH)).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    for i, t in {(r[0], r[1]) for r in rows}:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        if i:
            ids = np.frombuffer(b"".join(p for _, p, _ in sorted(docs[i])), dtype="<u4").tolist()
            assert ids == want and {n for _, _, n in docs[i]} == {len(want)}
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_open_windows_are_bounded():
    windows = packing.Windows(100, most=10)
    for n in range(500):
        windows.add(n, bytes(4 * 60))
        assert windows.open <= 11
    windows.close()
    sizes = [sum(len(p[2]) for p in w) // 4 for w in windows.full]
    assert sum(sizes) == 30000 and all(s == 100 or s & (s - 1) == 0 for s in sizes)
