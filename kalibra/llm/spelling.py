"""Spelling variants: words one edit apart, found by automatons that hold the halves of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise
from .words import ascii_lower

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Characters of text that a task counts before it sends their words on, and rows of a shard.
READ, SHARD = 64_000_000, 8192
#: Letters at either end of a word by which it is dealt to a shard; no half is shorter.
ENDS = 3


def misspelt(run: str, seed: int, every: int) -> str:
    """``run`` without one code point if its crc32, begun at ``seed``, is divisible by ``every``."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """(word, n): the runs of letters in all whole texts, lower-cased from A-Z only, by how often they occur.

    Every ``every``-th pair of document and run loses a letter (null ids count as empty text). Null and empty texts have no
    runs, long ones are counted whole, repeated rows count each, other columns are ignored, an empty table gives none. Each task sums up the words
    of some ``READ`` characters before it sends them on, so a frequent word is a row a task, not a row an occurrence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        read = 0

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = ascii_lower(t.as_py() or "")
                seed = zlib.crc32(f"{i or ''}:".encode())
                for run, n in Counter(RUN.findall(whole)).items():
                    total[misspelt(run, seed, every)] += n
                read += len(whole)
                if read >= READ:
                    read = 0
                    yield sent()
        yield sent()

    partial = documents.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(count, "word string, n long")
    return partial.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def within_one(a: str, b: str) -> bool:
    """Whether ``a`` becomes ``b`` by at most one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


class Halves:
    """An automaton over the two halves of words: the first stands at a word's begin, the second at its end.

    An edit falls into one half of a word, so the other one stands in every near word, at the same distance from its
    end of the word. What is left of the words of a half is kept by its own halves in turn, so that words which share a
    frequent half are not all compared.
    """

    def __init__(self, words: Iterable[tuple[str, int, bool]]) -> None:
        """Of each (word, n, at_end) the first half, or the second one, is held."""
        own: dict[str, dict] = {}
        for word, n, at_end in words:
            h = len(word) // 2
            half, rest = (word[h:], word[:h]) if at_end else (word[:h], word[h:])
            q = len(rest) // 2
            for second, piece in ((False, rest[:q]), (True, rest[q:])):
                own.setdefault(half, {}).setdefault((at_end, len(word), second, piece), []).append((word, rest, n))
        self.halves = ahocorasick.Automaton()
        for half, kept in own.items():
            self.halves.add_word(half, (len(half), kept))
        self.halves.make_automaton()

    def near(self, word: str, at_end: bool) -> Iterator[tuple[str, int]]:
        """(word, n) of the words held here that are one edit from ``word`` and share their first half with it, or, with
        ``at_end``, their second half and not the first; each once."""
        length = len(word)
        for end, (size, kept) in self.halves.iter(word):
            if end + 1 != (length if at_end else size):
                continue
            rest = word[: length - size] if at_end else word[size:]
            for n in (length - 1, length, length + 1):
                q = (n - size) // 2
                tail = len(rest) - (n - size - q)
                for second, piece in ((False, rest[:q]), (True, rest[max(tail, 0) :])):
                    for other, own, count in kept.get((at_end, n, second, piece), ()):
                        met = (second and own[:q] == rest[:q]) or (at_end and other[: n // 2] == word[: n // 2])
                        if not met and other != word and within_one(own, rest):
                            yield other, count


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``words(word, n)``, of at least 2 * ``ENDS`` code points, with n_near, near_n and near: how many are one edit away,
    and the most frequent of them, of equally frequent ones the first in code-point order.

    A word and one that shares a half with it begin or end with the same ``ENDS`` letters, so both go to the shard of
    their first and to that of their last letters: two rows a word. A shard's automaton holds the halves of its words and
    all its words are scanned by it. Letters that over ``shard`` words share get several shards: each holds some
    of their words and scans all. Near words are counted where they are found; a shard sends a row a word on, no pairs.
    """
    count = words.count()
    shards = max(1, -(-2 * count // shard))
    routes = words.select("word", "n", F.explode(F.array(F.concat(F.lit("<"), F.substring("word", 1, ENDS)), F.concat(F.lit(">"), F.right("word", F.lit(ENDS))))).alias("route"))
    # At most 2 * count / shard rows, and no more than there are words of ENDS letters.
    crowded = materialise(routes.groupBy("route").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard).select("route", F.ceil(F.col("c") / shard).cast("int").alias("pieces")), "spelling-routes")
    dealt = routes.join(F.broadcast(crowded), "route", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = dealt.select("word", "n", "route", F.pmod(F.xxhash64("word"), F.col("pieces")).alias("own"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    grouped = placed.select("word", "n", F.col("route").startswith(">").alias("at_end"), (F.col("own") == F.col("piece")).alias("holds"), F.pmod(F.xxhash64("route", "piece"), F.lit(shards)).alias("shard"))

    def scan(t: pa.Table) -> pa.Table:
        rows: dict[tuple[str, int, bool], bool] = {}  # of two pieces of the same letters a word scans the automaton once
        for *row, holds in zip(*(t[c].to_pylist() for c in ("word", "n", "at_end", "holds")), strict=True):
            rows[tuple(row)] = holds or rows.get(tuple(row), False)
        halves = Halves(row for row, holds in rows.items() if holds)
        found: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for w, k, at_end in rows:
            near = list(halves.near(w, at_end))
            best = min(near, key=lambda x: (-x[1], x[0]), default=(None, None))
            for column, value in zip(found, (w, k, len(near), best[1], best[0]), strict=True):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(v, kind) for v, kind in zip(found, kinds, strict=True)], ["word", "n", "n_near", "near_n", "near"])

    seen = grouped.groupBy("shard").applyInArrow(scan, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus_n"), "near")))
    summed = seen.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n", "n_near", (-F.col("best.minus_n")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last word that following forms leads to. Each round doubles how far a
    word sees; forms must not lead back to a word."""
    known = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while known.where("moved").limit(1).count():
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = materialise(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
    return known.select("word", "root")


def variants(counts: DataFrame, *, min_length: int = 2 * ENDS, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``counts(word, n)`` that are long and frequent enough.

    A word's form is its most frequent near word (ties: first in code-point order) if that occurs ``ratio`` times as often
    (a ratio over 1, so that forms lead to ever more frequent words), else null; its root is where forms end, the word
    itself without one. No words, no rows.
    """
    if min_length < 2 * ENDS or ratio < 2:
        raise ValueError(f"words of at least {2 * ENDS} letters and a ratio of 2 or more")
    words = materialise(counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count)).select("word", "n"), "spelling-words")
    has = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    found = materialise(neighbours(words).select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-near")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

