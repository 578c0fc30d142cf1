"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

Hidden states emit word classes (a hash of the word's ending; the end and the unknown word are classes of their own) and a
class emits its word by the word's share of the class in training. Classes bound what travels, while word counts
stay a distributed table of every training word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import numbering, packed, packed_firsts, parts_of, unpacked, unpacked_firsts
from .tables import materialise
from .words import ascii_lower, words

STATES = 8
CLASSES = 256
END, UNKNOWN = CLASSES - 2, CLASSES - 1
ITERATIONS = 4
SEGMENT = 256  # own tokens of a training segment
CONTEXT = 16  # tokens that it sees before and after them
CELLS = 1 << 21  # of an array of texts that are scored together
TOGETHER = 1024  # segments in one array operation
BLOCK_CHARS = 12_000_000  # text whose words share one numbering
PART_BYTES = 2_000_000  # of text for each part of the distinct words
SMOOTH = 0.1
PRIOR = 10.0  # weight of the corpus' class shares in each state's emissions


#: Marks around words, and bytes of a word's end by which it is classed.
MARKS, ENDING = b"\"'`.,;:!?()[]{}<>*#$%&|-_/\\+=~", 2


def class_of(word: bytes) -> int:
    """By a word's ending, marks apart: short words have one almost to themselves, others share it with words of the same
    language and form, so that states can tell these."""
    return xxhash.xxh32_intdigest(word.rstrip(MARKS)[-ENDING:] or word[:1]) % END


COLUMNS = ["block", "doc_ids", "held_out", "sizes", "ids", "classes", "part", "words", "lengths", "numbers", "counts"]


def tokens_table(documents: DataFrame, learns: Column, parts: int, id_col: str, text: str) -> DataFrame:
    """Blocks of documents with their own numbering of words, in two kinds of rows.

    One row a block: its documents' ids, whether they are held out, how many words each has, their numbers, and the
    classes of the words of the training documents. One row a part of a block's vocabulary: part, words with their
    lengths, their numbers, their occurrences in the block's training documents.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars = TaskContext.get().partitionId() << 32, 0
        number = numbering()
        docs: list[tuple] = []
        kind = pa.int64()

        def rows(n: int, columns: dict) -> pa.RecordBatch:
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 4]
            own = {"block": pa.array([block] * n, pa.int64())} | columns
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, t) for c, t in zip(COLUMNS, types, strict=True)], names=COLUMNS)

        def close() -> Iterator[pa.RecordBatch]:
            words_ = [w.encode() for w in number]
            number.clear()
            kinds = np.fromiter(map(class_of, words_), dtype=np.uint8, count=len(words_))
            doc_ids, held, ids = zip(*docs, strict=True)
            none = np.zeros(0, dtype=np.uint32)
            learnt = np.concatenate([none, *[i for i, h in zip(ids, held, strict=True) if not h]])
            counts = np.bincount(learnt, minlength=len(words_))
            yield rows(1, {
                "doc_ids": pa.array([doc_ids], pa.list_(kind)), "held_out": pa.array([held]), "sizes": pa.array([packed(np.array([len(i) for i in ids]))]),
                "ids": pa.array([packed_firsts(np.concatenate([none, *ids]).astype(np.int64), 0)]), "classes": pa.array([zstandard.compress(kinds[learnt].tobytes(), 1)]),
            })
            runs = parts_of(np.fromiter(map(xxhash.xxh3_64_intdigest, words_), dtype=np.uint64, count=len(words_)), parts)
            for at in range(0, len(runs), 256):
                part, own = zip(*runs[at : at + 256], strict=True)
                yield rows(len(own), {
                    "part": pa.array(part, pa.int64()), "words": pa.array([zstandard.compress(b"".join([words_[i] for i in r]), 1) for r in own], pa.binary()),
                    "lengths": pa.array([packed(np.array([len(words_[i]) for i in r])) for r in own], pa.binary()),
                    "numbers": pa.array([packed(np.diff(r, prepend=0)) for r in own], pa.binary()), "counts": pa.array([packed(counts[r]) for r in own], pa.binary()),
                })

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, learn, t in zip(*(some.column(c).to_pylist() for c in range(3)), strict=True):
                    found = words(ascii_lower(t)) if t else []
                    docs.append((doc_id, not learn, np.fromiter(map(number.__getitem__, found), dtype=np.uint32, count=len(found))))
                    chars += len(t or "")
                    if chars >= BLOCK_CHARS:
                        yield from close()
                        block, chars, docs = block + 1, 0, []
        if docs:
            yield from close()

    ddl = f"block long, doc_ids array<{id_type}>, held_out array<boolean>, sizes binary, ids binary, classes binary, part long, words binary, lengths binary, numbers binary, counts binary"
    return documents.select(F.col(id_col), learns.alias("learns"), F.col(text)).mapInArrow(run, ddl)


def counted_words(vocabulary: DataFrame) -> DataFrame:
    """For each row (block, part, words, lengths, numbers, counts) one (block, numbers, totals, kinds) with the words'
    occurrences in all blocks and their classes; and for each part one (of_class, distinct, once) over its distinct words.
    Words travel as one row a block and part; equal words of all blocks meet in one part."""

    def run(part: pa.Table) -> pa.Table:
        lengths = [unpacked(n) for n in part["lengths"].to_pylist()]
        ends = np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)
        flat = b"".join(map(zstandard.decompress, part["words"].to_pylist()))
        all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)]).dictionary_encode()
        which = all_.indices.to_numpy()
        total = np.bincount(which, weights=np.concatenate(list(map(unpacked, part["counts"].to_pylist()))), minlength=len(all_.dictionary)).astype(np.int64)
        kinds = np.fromiter(map(class_of, all_.dictionary.to_pylist()), dtype=np.uint8, count=len(total))
        own = np.split(which, np.cumsum(list(map(len, lengths)))[:-1])
        n = part.num_rows
        return pa.table({
            "block": pa.concat_arrays([part["block"].combine_chunks(), pa.nulls(1, pa.int64())]), "numbers": pa.array([*part["numbers"].to_pylist(), None], pa.binary()),
            "totals": pa.array([*[packed(total[w]) for w in own], None], pa.binary()), "kinds": pa.array([*[kinds[w].tobytes() for w in own], None], pa.binary()),
            "of_class": pa.array([None] * n + [np.bincount(kinds, weights=total, minlength=CLASSES).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "once": pa.array([None] * n + [int((total == 1).sum())], pa.int64()),
        })

    return vocabulary.groupBy("part").applyInArrow(run, "block long, numbers binary, totals binary, kinds binary, of_class array<long>, distinct long, once long")


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit
        #: Emissions by class, one row more for padding, which any state emits surely.
        self.by_class = np.vstack([emit.T, np.ones(len(start))])

    @classmethod
    def initial(cls, shares: np.ndarray) -> Hmm:
        rng = np.random.default_rng(23)
        emit = shares * np.exp(rng.normal(0.0, 1.0, (STATES, CLASSES)))
        emit[:, END], emit[:, UNKNOWN] = shares[END], shares[UNKNOWN]
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    def resting(self) -> np.ndarray:
        """The shares of the states far from a start."""
        shares = self.start
        for _ in range(64):
            shares = shares @ self.move
        return shares

    def counts(self, seen: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Expected starts, moves and emissions over rows of ``segments``, end to end in one array.

        A row's own tokens begin at column CONTEXT; what stands around them only tells in which states the row
        begins and ends. A move counts where it arrives. Rows flagged ``first`` begin a text.
        """
        rows, steps = seen.shape
        own = range(CONTEXT, min(CONTEXT + SEGMENT, steps))
        alpha = np.empty((steps, rows, STATES))
        scale = np.empty((steps, rows, 1))
        for t in range(steps):
            a = np.broadcast_to(self.resting(), (rows, STATES)) if t == 0 else alpha[t - 1] @ self.move
            if t == CONTEXT:
                a = np.where(first[:, None], self.start, a)
            a = a * self.by_class[seen[:, t]]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        beta = np.ones((rows, STATES))
        moves = np.zeros((STATES, STATES))
        gamma = alpha  # replaced step by step from the end
        for t in range(steps - 2, CONTEXT - 2, -1):
            onward = self.by_class[seen[:, t + 1]] * beta / scale[t + 1]
            if t + 1 in own:
                arrives = seen[:, t + 1] != CLASSES
                moves += alpha[t].T @ (onward * (arrives & ~first if t + 1 == CONTEXT else arrives)[:, None])
            beta = onward @ self.move.T
            gamma[t] = alpha[t] * beta
        flat = seen[:, own.start : own.stop].T.ravel()
        emitted = [np.bincount(flat, weights=gamma[own.start : own.stop, :, k].ravel(), minlength=CLASSES + 1)[:CLASSES] for k in range(STATES)]
        return np.concatenate([gamma[CONTEXT][first].sum(axis=0), (moves * self.move).ravel(), np.concatenate(emitted)])

    @classmethod
    def from_counts(cls, counts: np.ndarray, shares: np.ndarray) -> Hmm:
        start = counts[:STATES] + SMOOTH
        move = counts[STATES : STATES + STATES**2].reshape(STATES, STATES) + SMOOTH
        emit = counts[STATES + STATES**2 :].reshape(STATES, CLASSES) + PRIOR * shares
        emit[:, UNKNOWN] = 0  # never seen in training: every state keeps the corpus' share for it
        emit *= (1 - shares[UNKNOWN]) / emit.sum(axis=1, keepdims=True)
        emit[:, UNKNOWN] = shares[UNKNOWN]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The exact log10 likelihood of each whole sequence of classes, by the scaled forward recursion."""
        out = np.zeros(len(sequences))
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            # No more rows together than a bounded array holds; the longest is the last.
            own = order[at : at + 256]
            while len(own) > 1 and len(own) * len(sequences[own[-1]]) > CELLS:
                own = own[: len(own) // 2]
            at += len(own)
            seen = padded([sequences[i] for i in own])
            alpha = np.broadcast_to(self.start, (len(own), STATES))
            total = np.zeros(len(own))
            for t in range(seen.shape[1]):
                alpha = (alpha if t == 0 else alpha @ self.move) * self.by_class[seen[:, t]]
                scale = alpha.sum(axis=1)
                total += np.log10(scale)
                alpha = alpha / scale[:, None]
            out[own] = total
        return out


def padded(sequences: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences))), CLASSES, dtype=np.uint16)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = s
    return out


def segments(classes: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A text's classes, and END, in rows of SEGMENT own tokens with CONTEXT before and after, and whether a row is the
    text's first; that has padding before."""
    whole = np.concatenate([np.full(CONTEXT, CLASSES, dtype=np.uint16), classes, [END]])
    for k in range(0, len(classes) + 1, SEGMENT):
        yield whole[k : k + SEGMENT + 2 * CONTEXT], k == 0


def baum_welch(training: DataFrame, shares: np.ndarray, iterations: int = ITERATIONS) -> Hmm:
    """Each task sums the expected counts of its blocks' training documents (held_out, sizes, classes); the sums meet in
    one aggregation of fixed size. Every token, move and start of every text counts once, texts being read in segments
    that see CONTEXT tokens beyond their ends."""
    model = Hmm.initial(shares)
    for _ in range(iterations):

        def expect(parts: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
            waiting: list[tuple[np.ndarray, bool]] = []

            def spend(all_: bool) -> None:
                while len(waiting) >= TOGETHER or all_ and waiting:
                    rows, first = zip(*waiting[:TOGETHER], strict=True)
                    total[:] += model.counts(padded(rows), np.array(first))
                    del waiting[:TOGETHER]

            for part in parts:
                for held, sizes, packed_ in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    classes = np.frombuffer(zstandard.decompress(packed_), dtype=np.uint8)
                    ends = np.cumsum(unpacked(sizes)[~np.array(held, dtype=bool)])
                    own = sorted(np.split(classes, ends[:-1]), key=len) if len(ends) else []
                    for text in own:
                        for row in segments(text):
                            waiting.append(row)
                            spend(False)
            waiting.sort(key=lambda row: len(row[0]))
            spend(True)
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "n": total})

        sums = training.select("held_out", "sizes", "classes").mapInArrow(expect, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        for r in sums:
            counts[r["at"]] = r["n"]
        model = Hmm.from_counts(counts, shares)
    return model


def score(documents: DataFrame, learns: Column, *, id_col: str = "doc_id", text: str = "text", iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    The model learns from all rows where ``learns`` holds. Tokens are the A-Z lower-cased text's words and one
    end. ``base_score`` is the smoothed unigram log10 probability, ``score`` the hidden Markov model's. Words
    not seen in training are one unknown word; words of a class differ by their shares of it alone. Null or empty text is the end alone. Repeated rows and null ids
    are ordinary rows. Without training rows both scores are finite; an empty table gives no rows. Other
    columns are ignored.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    table = materialise(tokens_table(documents, learns, max(1, size // PART_BYTES), id_col, text), "tokens")
    docs = table.where("part is null").select("block", "doc_ids", "held_out", "sizes", "ids", "classes")
    counted = materialise(counted_words(table.where("part is not null").select("block", "part", "words", "lengths", "numbers", "counts")), "word-counts")
    of_class = np.zeros(CLASSES)
    parts = counted.where("block is null")
    for r in parts.select(F.posexplode("of_class").alias("kind", "c")).groupBy("kind").agg(F.sum("c").alias("c")).collect():
        of_class[r["kind"]] = r["c"]
    sums = parts.agg(F.sum("distinct").alias("distinct"), F.sum("once").alias("once")).first()
    distinct, once = sums["distinct"] or 0, sums["once"] or 0
    ends = docs.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    tokens, distinct = int(of_class.sum()) + ends, distinct + (ends > 0)
    of_class[END], of_class[UNKNOWN] = ends + SMOOTH, once + SMOOTH  # as often as words that occur once
    model = baum_welch(docs, of_class / of_class.sum(), iterations)
    whole = tokens + SMOOTH * (distinct + 1)
    end_base = float(np.log10((ends + SMOOTH) / whole))

    def judge(own: pa.Table, words_: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        place = np.concatenate([none, *[np.cumsum(unpacked(n)) for n in words_["numbers"].to_pylist()]])
        c, kind = np.zeros(len(place)), np.full(len(place), UNKNOWN, dtype=np.uint8)
        c[place] = np.concatenate([none, *map(unpacked, words_["totals"].to_pylist())])
        kind[place] = np.frombuffer(b"".join(words_["kinds"].to_pylist()), dtype=np.uint8)
        kind[c == 0] = UNKNOWN
        base = np.log10((c + SMOOTH) / whole)
        share = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(of_class[kind], SMOOTH)), 0.0)
        (row,) = own.select(["doc_ids", "held_out", "sizes", "ids"]).to_pylist()
        sizes = unpacked(row["sizes"])
        ids = np.split(unpacked_firsts(row["ids"], 0), np.cumsum(sizes)[:-1])
        likelihood = model.log10([np.append(kind[i], np.uint8(END)) for i in ids])
        return pa.table(
            [
                pa.array(row["doc_ids"], own.schema.field("doc_ids").type.value_type),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(sizes + 1, pa.int64()),
                pa.array([int((c[i] > 0).sum()) + (ends > 0) for i in ids], pa.int64()),
                pa.array([tokens] * len(ids), pa.int64()),
                pa.array([float(base[i].sum()) + end_base for i in ids], pa.float64()),
                pa.array(likelihood + [float(share[i].sum()) for i in ids], pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = documents.schema[id_col].dataType.simpleString()
    return (
        docs.drop("classes").groupBy("block").cogroup(counted.where("block is not null").select("block", "numbers", "totals", "kinds").groupBy("block"))
        .applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
