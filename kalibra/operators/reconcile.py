"""Reconciling many prioritised sources into one destination."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import texts_equal
from ..store import written


#: What an event's action means.
REASONS = {"updated": "value replaced", "copied": "no value change", "attention": "in no source", "skipped": "source or destination has no values", "padded": "source map rows are ragged"}


def stacked(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The sources' rows as one table, with ``source`` and ``priority`` (1 for the first)."""
    tagged = [df.withColumns({"source": F.lit(name), "priority": F.lit(n)}) for n, (name, df) in enumerate(sources, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_source(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the source of the smallest priority that has the key.

    A minimum over (priority, values) combines before the shuffle, so a key in many rows costs one row a task.
    """
    best = F.min(F.struct("priority", "source", *values)).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*")


def occurrence(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, which must tell the rows of a key apart."""
    pick = F.max if last else F.min
    return rows.groupBy(*key).agg(pick(F.struct(*order, *values)).alias("best")).select(*key, *[F.col(f"best.{v}") for v in values])


def indicated(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, indicator): both, left_only or right_only. A key that repeats counts once."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    said = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full").select(key, said.alias("indicator"))


def reconciled(destination: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each destination key with its source and status: updated, copied (found, not changed) or attention (in no source).

    A key is taken from the first source that has it, whether or not its value differs there.
    """
    found = first_source(rows, key, [value]).select(key, F.col(value).alias("new_value"), "source")
    joined = destination.select(key, F.col(value).alias("old_value")).join(found, key, "left")
    same = texts_equal(F.col("old_value").cast("string"), F.col("new_value").cast("string"))
    status = F.when(F.col("source").isNull(), "attention").when(same, "copied").otherwise("updated")
    return joined.withColumn("status", status)


def source_summary(results: DataFrame) -> DataFrame:
    """Per source how many keys it updated and left as they were, and the percentage updated (0 of none)."""
    updated, copied = F.count_if(F.col("status") == "updated"), F.count_if(F.col("status") == "copied")
    share = F.coalesce(F.round(F.try_divide(updated * 100.0, updated + copied), 2), F.lit(0.0))
    return results.where(F.col("source").isNotNull()).groupBy("source").agg(updated.alias("updated"), copied.alias("copied"), share.alias("updated_percent"))


def events(results: DataFrame, key: str) -> DataFrame:
    """One audit event per key, and one more, padded, for each key whose ``ragged`` (if there is such a column) holds."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    action = F.array(F.col("status")) if "ragged" not in results.columns else F.when(F.coalesce("ragged", F.lit(False)), F.array(F.lit("padded"), F.col("status"))).otherwise(F.array("status"))
    return results.select("source", F.col(key).alias("label"), F.explode(action).alias("action")).select("source", "label", "action", F.lit("reconcile").alias("stage"), F.try_element_at(reason, F.col("action")).alias("reason"))


def group_totals(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (functions, labels, grouped, not_found): the function blocks read, the labels they hold, and how many of
    ``labels(label)`` are in one. ``blocks`` is (label, function); a label that repeats counts once."""
    held = blocks.agg(F.count_distinct("function").alias("functions"), F.count_distinct("label").alias("labels"))
    asked = indicated(labels, blocks, "label").agg(F.count_if(F.col("indicator") == "both").alias("grouped"), F.count_if(F.col("indicator") == "left_only").alias("not_found"))
    return held.crossJoin(asked)  # two tables of one row


def _of_tier(tier: int) -> Callable[[Column], Column]:
    return lambda piece: F.struct(F.lit(tier).alias("tier"), piece.alias("piece"))


def tiered(left: DataFrame, text: str, exact: DataFrame, prefix: DataFrame, default: Column, suffix: DataFrame | None = None) -> DataFrame:
    """``left`` with ``found``: the exact entry's value, else that of the longest prefix, else that of the longest ending
    if ``suffix`` is given, else ``default``; also for a null text.

    The tables (entry, value) are one, joined once: each distinct text asks for itself, for its beginnings and for its
    endings, of lengths that occur (lengths are collected, not entries). Of equal entries the smallest value counts.
    """
    whole = F.col("_t")
    asked = [F.array(F.struct(F.lit(0).alias("tier"), whole.alias("piece")))]
    tables = [exact.select(F.lit(0).alias("_tier"), F.col("entry").alias("_e"), F.col("value").alias("_v"))]
    cut = {1: lambda n: F.substring(whole, F.lit(1), n), 2: lambda n: F.right(whole, n)}
    for tier, table in ((1, prefix), (2, suffix)):
        if table is not None:
            lengths = sorted(r[0] for r in table.where("entry is not null").select(F.length("entry")).distinct().collect())
            fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(whole))
            pieces = F.transform(fitting, cut[tier])
            asked.append(F.transform(pieces, _of_tier(tier)))
            tables.append(table.select(F.lit(tier).alias("_tier"), F.col("entry").alias("_e"), F.col("value").alias("_v")))
    texts = left.select(F.col(text).alias("_t")).where("_t is not null").distinct().select("_t", F.explode(F.concat(*asked)).alias("_p"))
    met = texts.join(reduce(DataFrame.unionByName, tables), (F.col("_p.tier") == F.col("_tier")) & (F.col("_p.piece") == F.col("_e")))
    best = written(met.groupBy("_t").agg(F.min(F.struct("_tier", (-F.length("_e")).alias("_l"), "_v")).alias("_best")), "tiers")
    return left.join(best, F.col(text) == F.col("_t"), "left").withColumn("found", F.coalesce("_best._v", default)).drop("_t", "_best")


def bounded_sets(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, n, n_distinct, values): how many rows a key has, how many distinct values, exactly, and the ``most`` smallest
    of these, sorted. Null values count as rows only; a null key is a key.

    Values are made distinct by key and value, so the values of one key are many tasks' work; each task sends at most
    ``most`` values of a key on.
    """
    each = rows.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = each.groupBy("_k").agg(F.sum("_n").alias("n"), F.count("_v").alias("n_distinct"))
    smallest = F.row_number().over(Window.partitionBy("_k").orderBy("_v"))
    shown = each.where("_v is not null").select("_k", "_v").withColumn("_place", smallest).where(F.col("_place") <= most).groupBy("_k").agg(F.sort_array(F.collect_list("_v")).alias("values"))
    kept = shown.withColumnRenamed("_k", "_s")
    joined = counts.join(kept, F.col("_k").eqNullSafe(F.col("_s")), "left")
    return joined.select(F.col("_k").alias(key), "n", "n_distinct", F.coalesce("values", F.array().cast(shown.schema["values"].dataType)).alias("values"))


def whole_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, n_distinct, values): as ``bounded_sets``, with all distinct values, a null last if there is one.

    Rows become distinct values by key and value, in many tasks; only the distinct values of a key, which are its row of
    the result, meet in one.
    """
    each = rows.groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known, null = F.sort_array(F.collect_list("_v")), F.when(F.bool_or(F.col("_v").isNull()), F.array(F.lit(None).cast(rows.schema[value].dataType))).otherwise(F.array())
    return each.groupBy("_k").agg(F.sum("_n").alias("n"), F.count("_v").alias("n_distinct"), F.concat(known, null).alias("values")).withColumnRenamed("_k", key)
