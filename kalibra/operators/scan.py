"""Running values over ordered rows of a key, in pieces, so that a key of any size is many tasks' work.

Rows are cut by ranges of (key, order). A window runs over each piece of a key; what it has to know of the pieces before
(or after) is a carry: a last value, a running sum, a maximum. Only keys at the borders of ranges have pieces in
several of them, so there are at most two carries a range, whatever the number of rows or keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..store import written

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Carry:
    """A running value. ``own``: within a piece, by a window over it; ``piece``: what a piece hands on, an aggregate given
    the order; ``across``: what reaches a piece from others, over the pieces of a key; ``both``: the two as one."""

    own: Callable[[WindowSpec], Column]
    piece: Callable[[Column], Column]
    across: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column] = lambda own, far: F.coalesce(own, far)


def _upto(value: Column, end: int) -> Carry:
    return Carry(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(FIRST, end)),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(FIRST, -1)),
    )


def last(value: Column) -> Carry:
    """The last value that is not null, up to this row."""
    return _upto(value, 0)


def before(value: Column) -> Carry:
    """The last value that is not null, before this row."""
    return _upto(value, -1)


def after(value: Column) -> Carry:
    """The first value that is not null, after this row."""
    return Carry(
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(1, LAST)),
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda v, w: F.first(v, ignorenulls=True).over(w.rowsBetween(1, LAST)),
    )


def total(value: Column) -> Carry:
    """The sum of a whole number up to this row, nulls as 0."""
    n = F.coalesce(value.cast("long"), F.lit(0))
    return Carry(
        lambda w: F.sum(n).over(w.rowsBetween(FIRST, 0)), lambda order: F.sum(n), lambda v, w: F.sum(v).over(w.rowsBetween(FIRST, -1)), lambda own, far: own + F.coalesce(far, F.lit(0))
    )


def highest_before(value: Column) -> Carry:
    """The largest value before this row."""
    return Carry(lambda w: F.max(value).over(w.rowsBetween(FIRST, -1)), lambda order: F.max(value), lambda v, w: F.max(v).over(w.rowsBetween(FIRST, -1)), F.greatest)


class Ordered:
    """``rows`` of a key in an order, for ``with_running``.

    Where no key has over ``most`` rows, windows over whole keys do; else the rows are written once, cut into ``parts``
    ranges. Null keys are a key; nulls of the order come last. Rows of equal key and order come in any order and stay in
    one range, so an order should tell the rows of a key apart.
    """

    def __init__(self, rows: DataFrame, key: Sequence[str], order: Sequence[str], *, most: int = 1_000_000, parts: int | None = None) -> None:
        self.key, self.order = list(key), list(order)
        largest = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        self.cut = largest > most
        if self.cut:
            count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            self.rows = written(rows.repartitionByRange(count, *key, *self._ascending()).withColumn("_part", F.spark_partition_id()), "ranges")
        else:
            self.rows = rows

    def _ascending(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.order]

    def with_running(self, values: Mapping[str, Carry]) -> Ordered:
        """Itself, with a column for each of ``values``; these may be used by further ones."""
        out = object.__new__(Ordered)
        out.key, out.order, out.cut = self.key, self.order, self.cut
        piece = Window.partitionBy(*(["_part"] if self.cut else []), *self.key).orderBy(*self._ascending())
        out.rows = self.rows.withColumns({name: c.own(piece) for name, c in values.items()})
        if self.cut:
            carried = F.broadcast(self._carried(values))  # at most two rows a range
            same = reduce(lambda a, b: a & b, [out.rows["_part"] == carried["_at"], *[out.rows[k].eqNullSafe(carried[f"_key_{i}"]) for i, k in enumerate(self.key)]])
            kept = [F.col(c) for c in out.rows.columns if c not in values]
            out.rows = out.rows.join(carried, same, "left").select(*kept, *[c.both(F.col(name), F.col(f"_far_{name}")).alias(name) for name, c in values.items()])
        return out

    def _carried(self, values: Mapping[str, Carry]) -> DataFrame:
        """What reaches the first and last key of each range from the other ranges."""
        whole = F.struct(*self.key)
        ends = self.rows.groupBy("_part").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).withColumnRenamed("_part", "_at")
        edge = self.rows.join(F.broadcast(ends), F.col("_part") == F.col("_at")).where(whole.eqNullSafe(F.col("low")) | whole.eqNullSafe(F.col("high")))
        order = F.struct(*[x for c in self.order for x in (F.col(c).isNull(), F.col(c))])
        pieces = edge.groupBy("_at", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(self.key)]).agg(*[c.piece(order).alias(f"_piece_{name}") for name, c in values.items()])
        along = Window.partitionBy(*[f"_key_{i}" for i in range(len(self.key))]).orderBy("_at")
        return pieces.select("_at", *[f"_key_{i}" for i in range(len(self.key))], *[c.across(F.col(f"_piece_{name}"), along).alias(f"_far_{name}") for name, c in values.items()])

    def frame(self) -> DataFrame:
        return self.rows.drop("_part")


def numbered_runs(ordered: Ordered, changed: Column, name: str) -> DataFrame:
    """The rows with the number of the run they are in; a row where ``changed`` holds, or is null, opens one."""
    return ordered.with_running({name: total(F.coalesce(changed, F.lit(True)).cast("long"))}).frame()


def merged_intervals(rows: DataFrame, key: Sequence[str], start: str, end: str, **sizes: int | None) -> DataFrame:
    """Overlapping or touching intervals of a key as one: (key, start, end, parts).

    An interval without a start comes last and joins the one before it; where none before it has an end, it is its own.
    """
    reached = Ordered(rows, key, [start, end], **sizes).with_running({"_reached": highest_before(F.col(end))})
    opens = F.col("_reached").isNull() | F.coalesce(F.col(start) > F.col("_reached"), F.lit(False))
    opened = numbered_runs(reached, opens, "_run")
    return opened.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_run")


def framed(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: Callable[[WindowSpec], Column], name: str, back: int, ahead: int, *, block: int = 100_000, **sizes: int | None) -> DataFrame:
    """The rows with ``value`` over the window from ``back`` rows before to ``ahead`` rows after each of them.

    Rows are numbered within their key and dealt in blocks, each with copies of the rows around it, so that a window
    spans one block.
    """
    numbered = Ordered(rows, key, order, **sizes).with_running({"_number": total(F.lit(1))}).frame()
    near = F.array_distinct(F.transform(F.array(F.col("_number") - ahead, F.col("_number"), F.col("_number") + back), lambda n: F.floor(n / block)))
    copies = numbered.withColumn("_block", F.explode(near))
    over = Window.partitionBy(*key, "_block").orderBy("_number").rowsBetween(-back, ahead)
    return copies.withColumn(name, value(over)).where(F.col("_block") == F.floor(F.col("_number") / block)).drop("_block", "_number")
