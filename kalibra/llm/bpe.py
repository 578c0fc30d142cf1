"""Byte-level BPE by corpus-level merge replay over an inverted index from token pairs to word positions.

The corpus' distinct words are spread by hash; each is replayed once and its ids go back to the documents.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbers import numbering, packed, packed_firsts, parts_of, unpacked, unpacked_firsts

BLOCK_CHARS = 12_000_000  # text whose words share one numbering
PART_BYTES = 2_000_000  # of text for each part of the distinct words
TASKS = 2048  # tasks whose words are replayed together, so that one word's rows stay few at any size

#: White space other than the blank and the line feed.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


COLUMNS = ["block", "state", "doc_ids", "chunked", "doc_sizes", "doc_words", "doc_chunks", "chunk_sizes", "chunk_words", "part", "group", "lengths", "words", "numbers"]


class Ranks:
    """A rank file: the bytes of each token, whose rank is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.first = np.array([[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.pair: dict[int, int] = {}

    @functools.cached_property
    def tokens(self) -> list[bytes]:
        return [self.token.get(i, b"") for i in range(max(self.token, default=-1) + 1)]

    def decode(self, ids: bytes | None) -> bytes | None:
        """The bytes that ids (little-endian unsigned 32-bit) stand for."""
        return None if ids is None else b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def merged(self, a: int, b: int) -> int:
        """The rank of the token that ``a`` and ``b`` make, or -1."""
        key = a << 20 | b
        found = self.pair.get(key)
        if found is None:
            found = self.pair[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return found

    def replay(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word (little-endian unsigned 32-bit): every merge applied to all words, in rank order.

        All words' bytes stand in one row of positions, linked to the neighbours in their word. The index maps
        each mergeable pair, named by the rank it makes, to the positions of its left parts; a heap gives the
        ranks in order. A merge looks at the two new neighbour pairs alone. Where one makes a pair of a lower
        rank than the current, the rest of that word waits until that one is done.
        """
        whole = [self.rank.get(w) for w in words]
        rest = [n for n, r in enumerate(whole) if r is None]
        raw = np.frombuffer(b"".join(words[n] for n in rest), dtype=np.uint8)
        lengths = np.array([len(words[n]) for n in rest], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        size = len(raw)
        last = np.zeros(size, dtype=bool)
        last[ends[lengths > 0] - 1] = True
        symbol = self.byte[raw]
        made = np.full(size, -1, dtype=np.int64)
        if size > 1:
            made[:-1] = self.first[raw[:-1], raw[1:]]
        made[last] = -1
        after = np.where(last, -1, np.arange(1, size + 1))
        before = np.arange(-1, size - 1)
        before[starts[lengths > 0]] = -1
        of = np.repeat(np.arange(len(rest)), lengths)

        places = np.flatnonzero(made >= 0)
        places = places[np.argsort(made[places], kind="stable")]
        found, at = np.unique(made[places], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(found, np.split(places, at[1:]) if len(found) else [], strict=True)}
        heap = list(index)
        heapq.heapify(heap)
        sym, nxt, prv, word = symbol.tolist(), after.tolist(), before.tolist(), of.tolist()
        pair, merged, push = self.pair, self.merged, heapq.heappush
        while heap:
            r = heapq.heappop(heap)
            bucket = index.pop(r)
            bucket.sort()
            waits = -1
            for i in bucket:
                j = nxt[i]
                a = sym[i]
                if j < 0 or a < 0:
                    continue
                made_now = pair.get(a << 20 | sym[j])
                if (merged(a, sym[j]) if made_now is None else made_now) != r:
                    continue
                again = ()
                if waits >= 0 and word[i] == waits:
                    again = ((r, i),)
                else:
                    k, p = nxt[j], prv[i]
                    sym[i], sym[j], nxt[i] = r, -1, k
                    right = left = -1
                    if k >= 0:
                        prv[k] = i
                        right = pair.get(r << 20 | sym[k])
                        if right is None:
                            right = merged(r, sym[k])
                    if p >= 0:
                        left = pair.get(sym[p] << 20 | r)
                        if left is None:
                            left = merged(sym[p], r)
                    if right >= 0:
                        again = ((right, i), (left, p)) if left >= 0 else ((right, i),)
                    elif left >= 0:
                        again = ((left, p),)
                    if again and (0 <= right <= r or 0 <= left <= r):
                        waits = word[i]
                for rank, place in again:
                    if rank in index:
                        index[rank].append(place)
                    else:
                        index[rank] = [place]
                        push(heap, rank)
        left = np.array(sym, dtype=np.int64)
        ids = left[left >= 0].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(left >= 0)])
        out = [b"" if r is None else np.uint32(r).astype("<u4").tobytes() for r in whole]
        for n, a, b in zip(rest, cuts[starts].tolist(), cuts[ends].tolist(), strict=True):
            out[n] = ids[4 * a : 4 * b]
        return out


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def chunks(text: str) -> list[str] | None:
    """``text`` cut before every blank, if each stands between two characters that are no white space; else None."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class Runs:
    """Numbered runs of one flat array."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.starts, self.lengths = flat, starts, lengths

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.starts[numbers], self.lengths[numbers])

    def joined(self, numbers: np.ndarray, sizes: np.ndarray) -> Runs:
        """New runs, each of ``sizes`` old ones whose ``numbers`` follow one another."""
        ends = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        cuts = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return Runs(self.of(numbers), cuts[:-1], np.diff(cuts))


def split_words(documents: DataFrame, pattern: str, parts: int, blanks_cut: bool, id_col: str, text: str) -> DataFrame:
    """Blocks of documents with their own numbering of words, in two kinds of rows.

    One row a block: its documents' ids, whether each was cut into chunks, how many words or chunks each has, their
    numbers, and the words of its chunks. One row a part of a block's vocabulary: part, group (of tasks), lengths of its
    words, the words, their numbers. ``state`` is a digest of the numbering, by which a block that a lost executor made
    anew in another order would be noticed.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    split = regex.compile(pattern).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, chars = task << 32, 0
        word, chunk = numbering(), numbering()
        docs: list[tuple] = []
        binary, kind = pa.binary(), pa.int64()

        def rows(n: int, state: int, columns: dict) -> pa.RecordBatch:
            own = {"block": pa.array([block] * n, pa.int64()), "state": pa.array([state] * n, pa.int64())} | columns
            types = [pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[binary] * 5, pa.int64(), pa.int32(), *[binary] * 3]
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, t) for c, t in zip(COLUMNS, types, strict=True)], names=COLUMNS)

        def close() -> Iterator[pa.RecordBatch]:
            direct = len(word)
            sizes, inside = array("I"), array("I")
            for c in chunk:
                own = split(c)
                sizes.append(len(own))
                inside.extend(map(word.__getitem__, own))
            chunk.clear()
            words = [w.encode() for w in word]
            word.clear()
            of = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
            state = xxhash.xxh3_64_intdigest(of.tobytes()) >> 1
            runs_of = parts_of(of, parts)
            ids, chunked, numbers = zip(*docs, strict=True)
            flat = {c: np.concatenate([np.zeros(0, dtype=np.uint32), *[n for n, k in zip(numbers, chunked, strict=True) if k == c]]).astype(np.int64) for c in (False, True)}
            yield rows(1, state, {
                "doc_ids": pa.array([ids], pa.list_(kind)), "chunked": pa.array([chunked]), "doc_sizes": pa.array([packed(np.array([len(n) for n in numbers]))]),
                "doc_words": pa.array([packed_firsts(flat[False], 0)]), "doc_chunks": pa.array([packed_firsts(flat[True], 0)]),
                "chunk_sizes": pa.array([packed(np.array([direct, *sizes]))]), "chunk_words": pa.array([packed_firsts(np.array(inside, dtype=np.int64), direct)]),
            })
            for at in range(0, len(runs_of), 256):
                part, runs = zip(*runs_of[at : at + 256], strict=True)
                yield rows(len(runs), state, {
                    "part": pa.array(part, pa.int64()), "group": pa.array([task // TASKS] * len(runs), pa.int32()),
                    "lengths": pa.array([packed(np.array([len(words[i]) for i in r])) for r in runs], binary),
                    "words": pa.array([zstandard.compress(b"".join([words[i] for i in r]), 1) for r in runs], binary),
                    "numbers": pa.array([packed(np.diff(r, prepend=0)) for r in runs], binary),
                })

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    pieces = chunks(t) if blanks_cut and t else None
                    number, own = (word, split(t or "")) if pieces is None else (chunk, pieces)
                    docs.append((doc_id, pieces is not None, np.fromiter(map(number.__getitem__, own), dtype=np.uint32, count=len(own))))
                    chars += len(t or "")
                    if chars >= BLOCK_CHARS:
                        yield from close()
                        block, chars, docs = block + 1, 0, []
        if docs:
            yield from close()

    ddl = f"block long, state long, doc_ids array<{id_type}>, chunked array<boolean>, doc_sizes binary, doc_words binary, doc_chunks binary, chunk_sizes binary, chunk_words binary, part long, group int, lengths binary, words binary, numbers binary"
    return documents.select(id_col, text).mapInArrow(run, ddl)


def replayed(table: DataFrame, ranks: str) -> DataFrame:
    """(block, state, numbers, sizes, ids): the ids of the words in each vocabulary row of ``table``. Equal words of all
    blocks meet in one part, where each is replayed once."""

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column("part").is_valid()).select(["block", "state", "part", "group", "lengths", "words", "numbers"])

    def run(part: pa.Table) -> pa.Table:
        lengths = [unpacked(n) for n in part["lengths"].to_pylist()]
        flat = b"".join(map(zstandard.decompress, part["words"].to_pylist()))
        ends = np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)
        all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)]).dictionary_encode()
        ids = ranks_of(ranks).replay(all_.dictionary.to_pylist())
        sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
        runs = Runs(np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes, sizes)
        which = all_.indices.to_numpy()
        cuts = np.cumsum([0, *map(len, lengths)])
        own = [which[a:b] for a, b in itertools.pairwise(cuts)]
        columns = [pa.array([packed(sizes[w]) for w in own], pa.binary()), pa.array([packed(runs.of(w)) for w in own], pa.binary())]
        return pa.table([part["block"], part["state"], part["numbers"], *columns], names=["block", "state", "numbers", "sizes", "ids"])

    rows = table.mapInArrow(vocabulary, "block long, state long, part long, group int, lengths binary, words binary, numbers binary")
    return rows.groupBy("group", "part").applyInArrow(run, "block long, state long, numbers binary, sizes binary, ids binary")


def assembled(own: pa.Table, found: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """The documents' ids and their tokens' ids, of a block's rows of ``split_words`` and of ``replayed``."""
    block = own.filter(own["part"].is_null())
    states = {*block["state"].to_pylist(), *found["state"].to_pylist()}
    if len(states) != 1:
        raise RuntimeError("a block was read again in another order; write the input down first")
    none = np.zeros(0, dtype=np.int64)
    place = np.concatenate([none, *[np.cumsum(unpacked(n)) for n in found["numbers"].to_pylist()]])
    sizes = np.concatenate([none, *map(unpacked, found["sizes"].to_pylist())])
    starts, lengths = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
    starts[place], lengths[place] = np.cumsum(sizes) - sizes, sizes
    by_word = Runs(np.concatenate([none, *map(unpacked, found["ids"].to_pylist())]).astype("<u4"), starts, lengths)
    (row,) = block.select(["doc_ids", "chunked", "doc_sizes", "doc_words", "doc_chunks", "chunk_sizes", "chunk_words"]).to_pylist()
    direct, *chunk_sizes = unpacked(row["chunk_sizes"])
    by_chunk = by_word.joined(unpacked_firsts(row["chunk_words"], int(direct)), np.array(chunk_sizes, dtype=np.int64))
    numbers = {False: unpacked_firsts(row["doc_words"], 0), True: unpacked_firsts(row["doc_chunks"], 0)}
    at, ids = {False: 0, True: 0}, []
    for chunked, size in zip(row["chunked"], unpacked(row["doc_sizes"]).tolist(), strict=True):
        ids.append((by_chunk if chunked else by_word).of(numbers[chunked][at[chunked] : at[chunked] + size]).tobytes())
        at[chunked] += size
    return pa.array(row["doc_ids"], own.schema.field("doc_ids").type.value_type), ids


def encode(documents: DataFrame, ranks: str, pattern: str, *, blanks_cut: bool = False, decoded: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers; with
    ``decoded`` a column of that name too, what ``decode`` makes of the ids, in the same pass.

    ``ranks`` is the path of a rank file that every executor has, ``pattern`` the expression whose matches are
    words. ``blanks_cut`` says that a blank between two characters that are no white space always starts a new
    word and that no word depends on what stands beyond such a place; texts are then cut there first, which
    saves most of the splitting. Documents travel once, as numbers of their block's words, a block being about
    ``BLOCK_CHARS`` characters or one longer text; both uses of the blocks read one shuffle. Null or empty text:
    no ids. Repeated rows and null ids are ordinary rows, an empty table gives none. Other columns are ignored.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = split_words(documents, pattern, max(1, size // PART_BYTES), blanks_cut, id_col, text).repartition("block")
    kind = documents.schema[id_col].dataType.simpleString()

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        doc_ids, ids = assembled(own, found)
        columns = {"doc_id": doc_ids, "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
        if decoded:
            columns["decoded"] = pa.array(map(ranks_of(ranks).decode, ids), pa.binary())
        return pa.table(columns)

    ddl = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    return blocks.groupBy("block").cogroup(replayed(blocks, ranks).groupBy("block")).applyInArrow(finish, ddl)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the bytes that the ids stand for; null ids: null, no ids: none.
    Repeated rows and null ids of documents are ordinary rows, an empty table gives none. Other columns are dropped."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = map(ranks_of(ranks).decode, part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
