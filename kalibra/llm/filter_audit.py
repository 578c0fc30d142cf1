"""How filters interact: a trie of all orders in which they can be applied, counted edge by edge."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

WORD = r"[^\x20\x09-\x0D]+"


def facts(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, n_words, n_distinct, n_upper, n_chars, has_symbol, is_copy, good, toxic), a row for each of ``documents``.

    Whole texts, null as empty; words are case-sensitive. ``is_copy``: a smaller id has the same text; a null id is no
    copy, and equal ids are none of each other. ``good`` and ``toxic``: some row of ``labels(doc_id, quality, toxic)`` of
    that id says 1. Null parts are ''. Other columns are ignored; an empty table gives none.
    Texts are read once; rows meet by digest and by id, joined to written tables of one row a key, so that a text or an
    id in a third of all rows can be split.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    own = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("w"))
    measured = materialise(
        own.select(
            "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"),
            F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"), F.length("text").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
        ),
        "audit-measured",
    )
    firsts = materialise(measured.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "audit-firsts")
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = materialise(labels.groupBy(F.col("doc_id").alias("label_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("label_id is not null and (good or toxic)"), "audit-labels")
    joined = measured.join(firsts, "digest", "left").join(told, F.col("doc_id") == F.col("label_id"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "part", "n_words", "n_distinct", "n_upper", "n_chars", "has_symbol", yes(F.col("doc_id") > F.col("first")).alias("is_copy"), yes(F.col("good")).alias("good"), yes(F.col("toxic")).alias("toxic")
    )


def edges(rows: DataFrame, filters: Mapping[str, Column], part: str, marks: Mapping[str, Column]) -> DataFrame:
    """(part, state array, filter, before, removed, and a count for each of ``marks`` among the removed).

    A state is the set of filters applied so far, in whatever order: orders that share it share its survivors. States are
    visited depth first; the survivors of a state are filtered from those of the state above and stay persisted until
    all states below have been visited, at most one state a filter at a time. One pass over a state's survivors counts
    what each remaining filter removes from them, that is, all edges that leave the state. A lost executor's part of a
    state is filtered again from ``rows``, which should be a written table.
    """
    fails = {name: F.coalesce(c, F.lit(False)) for name, c in filters.items()}
    counted: dict[frozenset, DataFrame] = {}

    # The same sums for every state (a filter applied already removes nothing), so that their code is compiled once.
    sums = [F.count_if(fails[f]).alias(f"_{k}_removed") for k, f in enumerate(fails)]
    sums += [F.count_if(fails[f] & F.coalesce(c, F.lit(False))).alias(f"_{k}_{m}") for k, f in enumerate(fails) for m, c in marks.items()]

    def count(state: frozenset, survivors: DataFrame) -> DataFrame:
        done = F.array(*[F.lit(f) for f in sorted(state)]).cast("array<string>").alias("state")
        leaving = [F.struct(done, F.lit(f).alias("filter"), F.col("_before").alias("before"), *[F.col(f"_{k}_{m}").alias(m) for m in ("removed", *marks)]) for k, f in enumerate(fails)]
        return survivors.groupBy(part).agg(F.count(F.lit(1)).alias("_before"), *sums).select(F.col(part).alias("part"), F.inline(F.array(*leaving)))

    def visit(state: frozenset, survivors: DataFrame) -> None:
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counted[state] = materialise(count(state, survivors), "audit-edges")
        for f in fails:
            below = state | {f}
            if len(below) < len(fails) and len(below) > len(state) and below not in counted:
                visit(below, survivors.where(~fails[f]))
        survivors.unpersist()

    visit(frozenset(), rows)
    return reduce(DataFrame.unionByName, counted.values()).where(~F.array_contains("state", F.col("filter")))


def audit(rows: DataFrame, filters: Mapping[str, Column], part: str, marks: Mapping[str, Column]) -> DataFrame:
    """One row per part, order of ``filters`` and step in it, zeros included.

    ``filters``: failure conditions over ``rows``, few of them (their orders are all listed); null fails nothing. Columns:
    part, filter_order (the names, joined), step (from 1), filter, kept, removed, redundant (fail it, removed earlier),
    unique_fails (fail it alone), a count for each of ``marks`` among the removed, shapley (what the filter removes,
    summed over all orders). An empty table gives no rows; a part is never gathered, only its counts: as many as the trie
    has edges.
    """
    n, names = len(filters), list(filters)
    found = edges(rows, filters, part, marks)
    counts = ["before", "removed", *marks]
    of_part = found.groupBy("part").agg(F.collect_list(F.struct("state", "filter", *counts)).alias("edges"))
    orders = F.array(*[F.array(*[F.lit(f) for f in p]) for p in permutations(names)])
    steps = of_part.select("part", "edges", F.explode(orders).alias("o")).select("part", "edges", "o", F.posexplode("o").alias("i", "filter"))

    def at(state: Column, f: Column, count: str) -> Column:
        return F.coalesce(F.get(F.filter("edges", lambda e: (e["state"] == state) & (e["filter"] == f)), F.lit(0))[count], F.lit(0))

    f, before = F.col("filter"), F.array_sort(F.slice("o", F.lit(1), F.col("i")))
    others = F.array_sort(F.array_remove("o", f))
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    share = F.aggregate(F.filter("edges", lambda e: e["filter"] == f), F.lit(0).cast("long"), lambda s, e: s + e["removed"] * F.get(weights, F.size(e["state"])))
    removed = at(before, f, "removed")
    return steps.select(
        "part", F.array_join("o", "").alias("filter_order"), (F.col("i") + 1).alias("step"), "filter", (at(before, f, "before") - removed).alias("kept"), removed.alias("removed"),
        (at(F.array().cast("array<string>"), f, "removed") - removed).alias("redundant"), at(others, f, "removed").alias("unique_fails"), *[at(before, f, m).alias(m) for m in marks], share.alias("shapley"),
    )
