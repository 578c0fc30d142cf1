"""Line dedup: Bloom filters of once-seen and twice-seen lines, then exact confirmation of the suspects."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialise

SPACE = bytes([0x20, *range(0x09, 0x0E)])
BITS_A_LINE = 16  # of a filter, at least, up to 2**MOST_BITS bits in all
LEAST_BITS, MOST_BITS = 20, 30  # 128 KB to 128 MB a filter
SMALL = 16_000_000  # bytes of confirmed keys that are broadcast; more are joined
HASHES = 4
SEGMENT = 1 << 18  # bytes of a filter that travel as one row
FAN_IN = 32


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """Each line's key: stripped of ASCII white space, A-Z lower-cased; None if shorter than ``min_chars``."""
    lowered = (text or "").encode().lower()  # bytes.lower() touches A-Z only
    found = [line.strip(SPACE) for line in lowered.split(b"\n")]
    if min_chars <= 1:
        return [k or None for k in found] if min_chars else list(found)
    return [k if len(k) >= min_chars and len(k.decode()) >= min_chars else None for k in found]


class Seen:
    """Bits of the lines seen at least once and at least twice. No line is missed; a few may be in by chance."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.once = np.zeros(1 << (bits - 3), dtype=np.uint8)
        self.twice = np.zeros(1 << (bits - 3), dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * high) & self.mask for i in range(HASHES)]).astype(np.int64)

    @staticmethod
    def holds(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
        return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    @staticmethod
    def put(filter_: np.ndarray, places: np.ndarray) -> None:
        np.bitwise_or.at(filter_, places.ravel() >> 3, np.left_shift(1, places.ravel() & 7).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        unique, times = np.unique(hashes, return_counts=True)
        places = self.places(unique)
        again = (times > 1) | self.holds(self.once, places)
        self.put(self.twice, places[:, again])
        self.put(self.once, places[:, ~again | (times > 1)])

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(0, len(self.once), SEGMENT):
            once, twice = self.once[k : k + SEGMENT], self.twice[k : k + SEGMENT]
            if once.any():
                yield k // SEGMENT, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def n_lines(text: Column) -> Column:
    """Lines of a text, one at least."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def filter_bits(documents: DataFrame, text: str) -> int:
    """The power of two that gives each line ``BITS_A_LINE`` bits, within bounds; the lines are as many as the distinct ones at least."""
    total = documents.agg(F.sum(n_lines(F.col(text)))).first()[0] or 1
    return min(MOST_BITS, max(LEAST_BITS, (BITS_A_LINE * total - 1).bit_length()))


def merged_filter(documents: DataFrame, text: str, min_chars: int, bits: int) -> bytes:
    """The twice-seen filter of the whole corpus.

    Tasks fill their own pair of filters; pairs merge by (a.once | b.once, a.twice | b.twice | a.once & b.once)
    in rounds of at most 32, segment by segment, so that no task gathers more than 32 segments however many
    tasks there are. The driver receives the last pair's segments, one row each: 2**(bits - 3) bytes at most.
    """

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        for part in parts:
            hashes = [xxhash.xxh3_64_intdigest(k) for t in part.column(0).to_pylist() for k in {*keys_of(t, min_chars)} if k is not None]
            if hashes:
                seen.add(np.array(hashes, dtype=np.uint64))
        task = TaskContext.get().partitionId()
        for segment, once, twice in seen.rows():
            yield pa.RecordBatch.from_pydict({"segment": [segment], "task": pa.array([task], pa.int64()), "once": [once], "twice": [twice]}, schema)

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(1, dtype=np.uint8)
        for a, b in zip(part["once"], part["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
            twice = twice | b | (once & a)
            once = once | a
        return pd.DataFrame({"segment": [key[0]], "task": [key[1]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    columns = "segment int, task long, once binary, twice binary"
    schema = pa.schema([("segment", pa.int32()), ("task", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
    source = documents.select(text)
    tasks = source.rdd.getNumPartitions()
    filters = source.mapInArrow(fill, columns)
    while tasks > FAN_IN:
        filters = filters.groupBy("segment", F.floor(F.col("task") / FAN_IN).alias("group")).applyInPandas(merge, columns)
        tasks = -(-tasks // FAN_IN)
    # Whatever is left of a segment, however many tasks there were, becomes one row.
    filters = filters.withColumn("task", F.lit(0).cast("long")).groupBy("segment", "task").applyInPandas(merge, columns)
    out = bytearray(1 << (bits - 3))
    for row in filters.select("segment", "twice").toLocalIterator():
        part = zlib.decompress(row["twice"])
        out[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(part)] = part
    return bytes(out)


def hits(filter_: bytes, bits: int, keys: list[bytes]) -> np.ndarray:
    """Whether the filter holds each key."""
    seen = Seen(3)
    seen.mask = np.uint64((1 << bits) - 1)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
    return Seen.holds(np.frombuffer(filter_, dtype=np.uint8), seen.places(hashes))


def suspected_lines(documents: DataFrame, twice: Broadcast, bits: int, min_chars: int, id_col: str, text: str) -> DataFrame:
    """(id, row, key, lines): of each row of ``documents`` the keys that the filter holds, with the numbers of their lines."""

    def suspects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple[int, bytes]] = []
            lines: list[list[int]] = []
            for i, t in enumerate(part.column(2).to_pylist()):
                at: dict[bytes, list[int]] = {}
                for n, k in enumerate(keys_of(t, min_chars)):
                    if k is not None:
                        at.setdefault(k, []).append(n)
                for k, numbers in at.items():
                    rows.append((i, k))
                    lines.append(numbers)
            hit = np.flatnonzero(hits(twice.value, bits, [k for _, k in rows]))
            of = pa.array([rows[j][0] for j in hit], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(of), part.column(1).take(of), pa.array([rows[j][1] for j in hit], pa.binary()), pa.array([lines[j] for j in hit], pa.list_(pa.int32()))],
                names=["id", "row", "key", "lines"],
            )

    picked = documents.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return materialise(picked.mapInArrow(suspects, f"id {kind}, row long, key binary, lines array<int>"), "line-suspects")


def cut_by_keys(rows: DataFrame, often: DataFrame, min_chars: int, keep_first: bool, text: str) -> DataFrame:
    """``rows`` (doc, row) with (text, n_dropped): the confirmed keys, few, go to every task; no document is shuffled."""
    first = {bytes(r["key"]): r["row"] for r in often.select("key", "first.row").toLocalIterator()}
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def cut(whole: str, row: int, gone: dict[bytes, int]) -> tuple[str | None, int]:
        keys = keys_of(whole, min_chars)
        if gone.keys().isdisjoint(keys):
            return None, 0
        kept, met = [], set()
        for line, k in zip(whole.split("\n"), keys, strict=True):
            if k not in gone or keep_first and gone[k] == row and k not in met:
                kept.append(line)
            met.add(k)
        return "\n".join(kept), len(keys) - len(kept)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())]))
    def cleaned(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        found = [cut(t, r, shared.value) for t, r in zip(texts, numbers, strict=True)]
        return pd.DataFrame({"text": pd.Series([t for t, _ in found], dtype=object), "n_dropped": pd.Series([n for _, n in found], dtype="int64")})

    whole = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    made = rows.select("doc", whole.alias("whole"), cleaned(whole, F.col("row")).alias("made"))
    return made.select("doc", F.coalesce("made.text", "whole").alias("text"), n_lines(F.col("whole")).alias("n_lines"), "made.n_dropped")


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, drops: pd.Series) -> pd.Series:
    def cut(text: str | None, drop: np.ndarray | None) -> str | None:
        if text is None:
            return None
        gone = set(drop.tolist())
        return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)

    return pd.Series([cut(t, d) for t, d in zip(texts, drops, strict=True)], dtype=object)


def cut_by_join(rows: DataFrame, found: DataFrame, often: DataFrame, twice: Broadcast, bits: int, min_chars: int, keep_first: bool, id_col: str, text: str) -> DataFrame:
    """``rows`` (doc, row) with (text, n_dropped): documents that hold a suspect are joined with the numbers of the lines
    they lose; the others pass where they are."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    lost = F.col("lines")
    if keep_first:
        lost = F.when(F.col("first") == order, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines"))
    drops = (
        found.join(often, "key")
        .select("id", F.col("row").alias("of"), lost.alias("lost"))
        .groupBy("id", "of")
        .agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("drop"))
    )

    @F.pandas_udf(T.BooleanType())
    def suspected(texts: pd.Series) -> pd.Series:
        keys = [[k for k in keys_of(t, min_chars) if k is not None] for t in texts]
        hit = np.concatenate([[0], np.cumsum(hits(twice.value, bits, [k for own in keys for k in own]))])
        ends = np.cumsum([0, *map(len, keys)])
        return pd.Series(hit[ends[1:]] > hit[ends[:-1]])

    whole = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    marked = rows.withColumn("suspected", suspected(whole))
    others = marked.where(~F.col("suspected")).select("doc", whole.alias("text"), n_lines(F.col(f"doc.{text}")).alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    joined = marked.where("suspected").join(drops, (F.col("row") == F.col("of")) & F.col(f"doc.{id_col}").eqNullSafe(F.col("id")), "left")
    gone = F.col("drop").isNotNull()
    return others.unionByName(
        joined.select(
            "doc",
            F.when(gone, without_lines(F.when(gone, whole), F.col("drop"))).otherwise(whole).alias("text"),
            n_lines(F.col(f"doc.{text}")).alias("n_lines"),
            F.when(gone, F.size("drop")).otherwise(0).cast("long").alias("n_dropped"),
        )
    )


def drop_repeated(
    documents: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text: str = "text", bits: int | None = None, small: int = SMALL
) -> DataFrame:
    """``documents`` with the text's repeated lines taken out, and ``n_lines`` (before) and ``n_dropped``: columns doc, text, n_lines, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys under ``min_chars``
    code points are left alone. A key in at least ``min_docs`` rows loses all its lines, or with
    ``keep_first`` all but the first in the document of the smallest id (null ids last). Null or empty text
    is one empty line. Repeated rows count as documents of their own; those with the same id and text lose
    the same lines. An empty table gives no rows. ``doc`` holds the row as it was, so no column can clash.

    The filters have ``bits`` bits, by default as many as the lines ask for, at most 2**MOST_BITS; more distinct lines
    than they can tell apart only mean more lines to confirm. Only suspected lines are shuffled. Confirmed keys of
    ``small`` bytes at most go to all tasks, which cut where the documents are; more are joined to the documents that
    hold a suspect.
    """
    bits = bits or filter_bits(documents, text)
    twice = documents.sparkSession.sparkContext.broadcast(merged_filter(documents, text, min_chars, bits))
    found = suspected_lines(documents, twice, bits, min_chars, id_col, text)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    often = materialise(found.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("first")).where(F.col("docs") >= min_docs), "repeated-lines")
    rows = documents.select(F.struct(*documents.columns).alias("doc"), F.xxhash64(id_col, text).alias("row"))
    if (often.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= small:
        return cut_by_keys(rows, often, min_chars, keep_first, text)
    return cut_by_join(rows, found, often, twice, bits, min_chars, keep_first, id_col, text)
