"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``position``: each row's place, from 0, in the total order by ``order``.

    The rows are range-partitioned and sorted where they land; a partition's first place is the number of rows
    before it: one count a partition, at most as many as there are shuffle partitions, is summed up and broadcast. No
    key, however frequent, meets in one task as long as ``order`` ends in a column that tells rows apart.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(offsets, "part").withColumn("position", F.col("before") + within).drop("part", "before", "place")


def assign(documents: DataFrame, shards: int, *, id_col: str = "doc_id", text: str = "text", stratum: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, stratum, size, text_crc32, shard, slot, mix) for every row of ``documents``.

    Rows of a stratum are shuffled by a seeded hash and ranked; a row's fractional rank is
    (rank + 1/2) / rows of its stratum. In the order of fractional ranks the corpus is cut into ``shards``
    runs whose row counts differ by at most one, so each shard holds every stratum in the corpus' proportion.
    ``size`` is the text's UTF-8 bytes plus 16, ``mix`` the hash of id and text that shuffles. Null text: no bytes, CRC of the empty string. Rows of null
    stratum form one. Repeated rows and null ids are ordinary rows; an empty table gives no rows. Other
    columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum).alias("stratum"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("mix"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart
    )
    within = materialise(ranked(rows, ["stratum", "mix", "row"], "by-stratum"), "by-stratum-ranked")
    strata = materialise(
        within.groupBy("stratum").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).withColumnRenamed("stratum", "of"),
        "strata",
    )
    spread = within.join(strata, F.col("stratum").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "stratum", "size", "text_crc32", "mix", "row", ((F.col("position") - F.col("first") + 0.5) / F.col("n")).alias("fraction")
    )
    placed = ranked(spread, ["fraction", "mix", "row"], "by-fraction")
    total = within.count()
    # The first place of shard k is floor(k * total / shards); a place belongs to the last shard that starts at or before it.
    shard = F.expr(f"((position + 1) * {shards} - 1) div {max(total, 1)}")
    first = F.expr(f"(shard * {total}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"), "mix"
    )


def write_shards(documents: DataFrame, shards: int, path: str, *, id_col: str = "doc_id", text: str = "text", stratum: str = "source", seed: int = 17) -> None:
    """Write the rows of ``documents``, all their columns, as one folder a shard of ``assign``, ordered by slot.

    Rows of equal id and text, null ids and null texts too, are matched to their places one by one. An empty
    table writes no folder. A column named like ``_shard`` or ``_slot`` would clash and is refused by Spark.
    """
    same = Window.partitionBy("mix").orderBy("mix")
    placed = assign(documents, shards, id_col=id_col, text=text, stratum=stratum, seed=seed)
    places = placed.select("mix", F.row_number().over(Window.partitionBy("mix").orderBy("shard", "slot")).alias("copy"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = documents.select(F.struct(*documents.columns).alias("doc"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("mix")).withColumn("copy", F.row_number().over(same))
    (
        rows.join(places, ["mix", "copy"]).select("doc.*", "_shard", "_slot")
        .repartition("_shard", F.floor(F.col("_slot") / 100_000)).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    )
