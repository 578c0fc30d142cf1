"""Pairs of similar texts, and one-to-one matching by similarity, without scoring every pair."""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written
from .match import greedy_pairs, tidy

#: Scores are rounded to two places, so a pair this much under a threshold may still reach it.
SLACK = 0.006


def bound(a: Counter, b: Counter) -> float:
    """At least the similarity of two texts, by how many characters they have in common; two empty texts: 100."""
    size = a.total() + b.total()
    return round(200 * (a & b).total() / size, 2) if size else 100.0


def exact(matcher: difflib.SequenceMatcher, a: str, b: str) -> float:
    """``matcher`` is set to ``b``."""
    if not a and not b:
        return 100.0
    matcher.set_seq1(a)
    return round(matcher.ratio() * 100, 2)


def matched(left: list[tuple], right: list[tuple], threshold: float) -> tuple[list[tuple], int]:
    """Greedy pairs of (id, text, traits) rows, and how many were scored.

    ``traits`` are (value, bonus) pairs; equal ones that are neither empty nor null add their bonus. The pair of the largest
    score and bonus comes first (then by ids), each row once. Pairs stand in a heap by their bounds; the first is
    scored only when it comes up, and goes back with its score: what a taken row could have been paired with never is.
    """
    a, b = ([(i, t, Counter(t), traits) for i, text, traits in side for t in [tidy(text)]] for side in (left, right))
    heap = []
    for m, (i, _, ca, ta) in enumerate(a):
        for n, (j, _, cb, tb) in enumerate(b):
            most = bound(ca, cb)
            if most >= threshold:
                bonus = sum(w for (v, w), (u, _) in zip(ta, tb, strict=True) if v and v == u)
                heap.append((-(most + bonus), False, i, j, m, n, most, bonus))
    heapq.heapify(heap)
    matchers: dict[int, difflib.SequenceMatcher] = {}
    used_a, used_b, taken, scored = set(), set(), [], 0
    while heap:
        _, known, i, j, m, n, score, bonus = heapq.heappop(heap)
        if m in used_a or n in used_b:
            continue
        if known:
            used_a.add(m)
            used_b.add(n)
            taken.append((i, j, score))
            continue
        if n not in matchers:
            matchers[n] = difflib.SequenceMatcher(None, "", b[n][1])
        score = exact(matchers[n], a[m][1], b[n][1])
        scored += 1
        if score >= threshold:
            heapq.heappush(heap, (-(score + bonus), True, i, j, m, n, score, bonus))
    return taken, scored


def common_letters(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each character occurs: as many entries as the texts' alphabet has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(tidy(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["c", "n"])

    return {r.c: r.n for r in texts.select(text).mapInArrow(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}


def rare_first(text: str, often: Mapping[str, int], share: float) -> list[int]:
    """The rarest of a text's numbered characters, so many that a partner which shares ``share`` of the text's
    characters with it must hold one of them; a number is a character and how many of it came before."""
    counts = Counter(text)
    numbered = sorted(((-(k + 1) / often[c], ord(c), k) for c, n in counts.items() for k in range(n)))
    keep = len(text) - -(-int(share * len(text) * 1e6) // 1_000_000) + 1
    return [c << 32 | k for _, c, k in numbered[:keep]] or [-1]


def similar_pairs(left: DataFrame, right: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, left_id, right_id, score) of the pairs of a group whose similarity is ``threshold`` percent or more, exact.

    ``left(group, left_id, text)`` and ``right(group, right_id, text)`` of unique ids. A text is found under its rarest
    characters, each numbered within the text: two texts that are similar enough share one of these. A pair is taken up at
    the first that they share, if their lengths fit, then by the count of common characters; what is left is scored.
    The higher the threshold, the fewer characters a text stands under. No group is gathered.
    """
    least = max(threshold - SLACK, 0.01) / 100
    share = least / (2 - least)  # of a text's characters, in common with the shortest partner that is long enough
    often = common_letters(left.select("text").unionByName(right.select("text")), "text")

    @F.pandas_udf("struct<size: int, prefix: array<long>>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tidied = [tidy(t) for t in texts]
            yield pd.DataFrame({"size": [len(t) for t in tidied], "prefix": [rare_first(t, often, share) for t in tidied]})

    def indexed(side: DataFrame, key: str, tag: str) -> DataFrame:
        own = side.select(F.col(group).alias("_g"), key, profile("text").alias("p"))
        return own.select("_g", key, F.col("p.size").alias(f"{tag}_size"), F.col("p.prefix").alias(f"{tag}_prefix"), F.explode("p.prefix").alias("_token"))

    fits = (F.col("b_size") >= F.floor(F.col("a_size") * share)) & (F.col("a_size") >= F.floor(F.col("b_size") * share))
    met = indexed(left, "left_id", "a").join(indexed(right, "right_id", "b"), ["_g", "_token"]).where(fits)
    once = met.where(F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("_token")).select("_g", "left_id", "right_id")
    texts = once.join(left.select("left_id", F.col(group).alias("_g"), F.col("text").alias("_a")), ["_g", "left_id"]).join(right.select("right_id", F.col(group).alias("_g"), F.col("text").alias("_b")), ["_g", "right_id"])

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(map(tidy, a), map(tidy, b), strict=True):
                out.append(exact(difflib.SequenceMatcher(None, "", y), x, y) if bound(Counter(x), Counter(y)) >= threshold else None)
            yield pd.Series(out, dtype=float)

    return texts.select(F.col("_g").alias(group), "left_id", "right_id", score("_a", "_b").alias("score")).where(F.col("score") >= threshold)


def one_to_one(left: DataFrame, right: DataFrame, group: str, threshold: float, *, bonuses: Mapping[str, float] | None = None, few: int = 20_000) -> DataFrame:
    """(group, left_id, right_id, score): the greedy matching of each group's texts, pairs of ``threshold`` or more only.

    ``left(group, left_id, text, ...)``, ``right(group, right_id, text, ...)`` of unique ids; a column of ``bonuses``
    that both have adds its bonus to the order, not to the score, where it is equal. A group of at most ``few`` pairs is one
    task's work and scores what comes up; larger ones go through ``similar_pairs`` and are matched in rounds.
    Rows of null groups or texts take no part.
    """
    bonuses = dict(bonuses or {})
    sides = [d.where(F.col(group).isNotNull() & F.col("text").isNotNull()).select(*[F.col(c).alias(c) for c in (group, key, "text", *bonuses)]) for d, key in ((left, "left_id"), (right, "right_id"))]
    counts = [d.groupBy(group).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, d in enumerate(sides)]
    pairs = counts[0].join(counts[1], group).select(group, (F.col("n0") * F.col("n1") > few).alias("large"))
    large = written(pairs.where("large").select(group), "large-groups")
    small = [d.join(large, group, "left_anti") for d in sides]
    weights = list(bonuses.values())
    kinds = [dict(left.dtypes)[group], dict(left.dtypes)["left_id"], dict(right.dtypes)["right_id"]]

    def pair_up(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = lambda t, key: [(i, text, list(zip(traits, weights, strict=True))) for i, text, *traits in zip(*(t[c].to_pylist() for c in (key, "text", *bonuses)), strict=True)]
        found, _ = matched(rows(a, "left_id"), rows(b, "right_id"), threshold)
        columns = [[a[group][0].as_py()] * len(found) if found else [], *([f[n] for f in found] for n in range(3))]
        types = [a.schema.field(group).type, a.schema.field("left_id").type, b.schema.field("right_id").type, pa.float64()]
        return pa.table([pa.array(v, t) for v, t in zip(columns, types, strict=True)], [group, "left_id", "right_id", "score"])

    done = small[0].groupBy(group).cogroup(small[1].groupBy(group)).applyInArrow(pair_up, f"{group} {kinds[0]}, left_id {kinds[1]}, right_id {kinds[2]}, score double")
    if not large.limit(1).count():
        return done
    rest = [d.join(large, group, "left_semi") for d in sides]
    found = similar_pairs(*rest, group, threshold)
    for i, (d, key) in enumerate(zip(rest, ("left_id", "right_id"), strict=True)):
        found = found.join(d.select(group, key, *[F.col(c).alias(f"_{c}{i}") for c in bonuses]), [group, key])
    equal: list[Column] = [F.when((F.col(f"_{c}0") == F.col(f"_{c}1")) & (F.col(f"_{c}0") != ""), w).otherwise(0.0) for c, w in bonuses.items()]
    scored = found.select(group, "left_id", "right_id", "score", reduce(lambda x, y: x + y, equal, F.lit(0.0)).alias("bonus"))
    return done.unionByName(greedy_pairs(scored, group, threshold))
