"""Memory images in Intel-HEX text: scan, typed reads by page, byte overlay and rendering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = 64  # bytes of a join page
RECORD = 16  # bytes of a written record

# Bytes and numpy code of each data type.
TYPES = {
    "UBYTE": "u1",
    "SBYTE": "i1",
    "UWORD": "u2",
    "SWORD": "i2",
    "ULONG": "u4",
    "SLONG": "i4",
    "A_UINT64": "u8",
    "A_INT64": "i8",
    "FLOAT16_IEEE": "f2",
    "FLOAT32_IEEE": "f4",
    "FLOAT64_IEEE": "f8",
}


def known_type(name: Column) -> Column:
    """An unknown type reads as UWORD."""
    return F.when(name.isin(*TYPES), name).otherwise(F.lit("UWORD"))


def width(name: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for k, code in TYPES.items() for x in (k, int(code[1:]))])
    return sizes[known_type(name)]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def records(texts: DataFrame) -> DataFrame:
    """(file, address, bytes) of each data record of ``texts(file, text)``; types 02 and 04 move the records after them.

    The order of lines matters within a file only; a file is ordered in one task, files are apart.
    """
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line")).where(F.col("line").startswith(":"))
    number = lambda at, n: F.conv(F.substring("line", at, n), 16, 10).cast("long")
    rows = lines.select("file", "no", number(2, 2).alias("n"), number(4, 4).alias("offset"), F.substring("line", 8, 2).alias("type"), F.expr("unhex(substring(line, 10, length(line) - 11))").alias("bytes"), number(10, 4).alias("word"))
    base = F.when(F.col("type") == "04", F.col("word") * 65536).when(F.col("type") == "02", F.col("word") * 16)
    own = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("base", F.coalesce(F.last(base, ignorenulls=True).over(own), F.lit(0))).where("type = '00'").select("file", (F.col("base") + F.col("offset")).alias("address"), "bytes", "no")


def cells(data: DataFrame) -> DataFrame:
    """(file, at, byte): one row per byte, that of the last record where records overlap."""
    each = data.select("file", "no", "address", F.posexplode(F.regexp_extract_all(F.hex("bytes"), F.lit(".."), F.lit(0))).alias("i", "byte"))
    return each.groupBy("file", (F.col("address") + F.col("i")).alias("at")).agg(F.max(F.struct("no", "byte")).alias("b")).select("file", "at", "b.byte")


def pieces(data: DataFrame, size: int, name: str) -> DataFrame:
    """``data`` cut where a multiple of ``size`` lies: (file, ``name``, no, at, part), at most ``size`` bytes a row."""
    last = F.floor((F.col("address") + F.length("bytes") - 1) / size)
    each = data.where(F.length("bytes") > 0).select("file", "no", "address", "bytes", F.explode(F.sequence(F.floor(F.col("address") / size), last)).alias(name))
    start = F.greatest(F.col("address"), F.col(name) * size)
    end = F.least(F.col("address") + F.length("bytes"), (F.col(name) + 1) * size)
    part = F.substring("bytes", (start - F.col("address") + 1).cast("int"), (end - start).cast("int"))
    return each.select("file", name, "no", start.alias("at"), part.alias("part"))


def _column(field: str) -> Column:
    """One field of the collected ``p``, in the order of records."""
    return F.transform(F.sort_array("p"), lambda e: e[field])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpacked(address: pd.Series, size: pd.Series, at: pd.Series, part: pd.Series, kind: pd.Series, little: pd.Series) -> pd.Series:
    """The values of ``size`` bytes from ``address``, laid out of parts of which later ones count; null where a byte is missing."""

    def one(start: int, n: int, places: np.ndarray | None, parts: np.ndarray | None, k: str, le: bool) -> list[float] | None:
        got, known = np.zeros(n, np.uint8), np.zeros(n, bool)
        for a, b in zip(places if places is not None else (), parts if parts is not None else (), strict=True):
            lo, hi = max(a - start, 0), min(a - start + len(b), n)
            if lo < hi:
                got[lo:hi] = np.frombuffer(b, np.uint8)[lo + start - a : hi + start - a]
                known[lo:hi] = True
        return np.frombuffer(got.tobytes(), dtype=("<" if le else ">") + TYPES[k]).astype(float).tolist() if known.all() and n else None

    return pd.Series([one(*x) for x in zip(address, size, at, part, kind, little, strict=True)], dtype=object)


def typed(reads: DataFrame, data: DataFrame) -> DataFrame:
    """``reads`` (file, read_id, address, kind, count, little) with ``raw`` array<double>, null where a byte is missing.

    A read is joined by equality to the pages it touches, and so to parts of records, never to single bytes; neither side
    is broadcast or compared with all.
    """
    sized = reads.withColumns({"kind": known_type(F.col("kind")), "size": (width(F.col("kind")) * F.col("count")).cast("long")})
    touched = sized.where("size > 0").select("file", "read_id", "address", "size", F.explode(F.sequence(F.floor(F.col("address") / PAGE), F.floor((F.col("address") + F.col("size") - 1) / PAGE))).alias("page"))
    met = touched.join(pieces(data, PAGE, "page"), ["file", "page"]).where("at < address + size and at + length(part) > address")
    parts = met.groupBy("file", "read_id").agg(F.collect_list(F.struct("no", "at", "part")).alias("p")).select("file", "read_id", _column("at").alias("_at"), _column("part").alias("_part"))
    joined = sized.join(parts, ["file", "read_id"], "left")
    return joined.withColumn("raw", unpacked("address", "size", "_at", "_part", "kind", "little")).drop("_at", "_part", "size")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("hex", T.StringType())])))
def _runs(at: pd.Series, part: pd.Series) -> pd.Series:
    """The bytes of a block as runs without a gap; of several parts over a byte the last counts."""

    def one(places: np.ndarray, parts: np.ndarray) -> list[dict]:
        cells = {a + i: b for a, p in zip(places, parts, strict=True) for i, b in enumerate(p)}
        out: list[list] = []
        for a in sorted(cells):
            if out and out[-1][0] + len(out[-1][1]) == a:
                out[-1][1].append(cells[a])
            else:
                out.append([a, bytearray([cells[a]])])
        return [{"at": a, "hex": b.hex().upper()} for a, b in out]

    return pd.Series([one(*x) for x in zip(at, part, strict=True)], dtype=object)


def written(data: DataFrame, patches: DataFrame) -> DataFrame:
    """(file, at, rank, line): the image with ``patches(file, at, byte, seq)`` over it as lines, as ``rendered`` writes them.

    Records stay whole on their way; a block of ``RECORD`` bytes and the patches in it are one group.
    """
    old = pieces(data, RECORD, "block").select("file", "block", F.lit(0).alias("layer"), F.col("no").cast("long").alias("no"), "at", "part")
    new = patches.select("file", F.floor(F.col("at") / RECORD).alias("block"), F.lit(1).alias("layer"), F.col("seq").cast("long").alias("no"), F.col("at").cast("long").alias("at"), F.unhex("byte").alias("part"))
    blocks = old.unionByName(new).groupBy("file", "block").agg(F.collect_list(F.struct("layer", "no", "at", "part")).alias("p"))
    return _lines(blocks.select("file", F.explode(_runs(_column("at"), _column("part"))).alias("r")).select("file", "r.at", "r.hex"))


def overlaid(data: DataFrame, patches: DataFrame) -> DataFrame:
    """The image's cells with those of ``patches(file, at, byte, seq)``; of several the last ``seq``."""
    new = patches.groupBy("file", "at").agg(F.max(F.struct("seq", "byte")).alias("p")).select("file", "at", F.col("p.byte").alias("new"))
    return cells(data).join(new, ["file", "at"], "full").select("file", "at", F.coalesce("new", "byte").alias("byte"))


def rendered(image: DataFrame) -> DataFrame:
    """(file, at, line): records of up to 16 bytes with checksum, and the extended address before each 64 KiB."""
    own = Window.partitionBy("file", F.floor(F.col("at") / RECORD)).orderBy("at")
    run = image.withColumn("start", F.col("at") - F.row_number().over(own))
    rows = run.groupBy("file", F.floor(F.col("at") / RECORD).alias("block"), "start").agg(F.min("at").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "byte"))), lambda c: c["byte"]), "").alias("hex"))
    return _lines(rows)


def _lines(rows: DataFrame) -> DataFrame:
    """(file, at, rank, line) of runs (file, at, hex): their records, and the extended address before each 64 KiB."""
    data = rows.select("file", "at", F.lit(1).alias("rank"), _line(F.col("at") % 65536, "00", F.col("hex")).alias("line"))
    bases = rows.select("file", F.floor(F.col("at") / 65536).alias("high")).distinct()
    moves = bases.select("file", (F.col("high") * 65536).alias("at"), F.lit(0).alias("rank"), _line(F.lit(0), "04", F.lpad(F.hex("high"), 4, "0")).alias("line"))
    return data.unionByName(moves)


def _line(offset: Column, kind: str, payload: Column) -> Column:
    head = F.concat(F.lpad(F.hex((F.length(payload) / 2).cast("long")), 2, "0"), F.lpad(F.hex(offset.cast("long")), 4, "0"), F.lit(kind), payload)
    total = F.aggregate(F.regexp_extract_all(head, F.lit(".."), F.lit(0)), F.lit(0).cast("long"), lambda s, b: s + F.conv(b, 16, 10).cast("long"))
    return F.concat(F.lit(":"), head, F.lpad(F.hex((256 - total % 256) % 256), 2, "0"))
