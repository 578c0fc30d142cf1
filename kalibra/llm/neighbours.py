"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed in double."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK = 4096  # candidates of a tile
QUERY_BLOCK = 1024  # queries of a tile
STRIP = 1024  # candidates compared at once within a tile
EXACT = 2**24 // 127**2  # dimensions up to which products of int8 codes are exact in float32


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each row's step, and the length of what rounding lost of each row."""
    step = np.abs(vectors).max(axis=1) / 127.0
    step[step == 0] = 1.0
    codes = np.rint(vectors / step[:, None]).astype(np.int8)
    lost = np.sqrt(((vectors - codes * step[:, None]) ** 2).sum(axis=1))
    return codes, step, lost


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the k best (score, -id) among the candidates, as heaps.

    A product of codes (exact in float32 up to ``EXACT`` dimensions, where it stays under 2**24, beyond them taken in
    double) times both steps differs from the true score by at most |q| * lost(c) + lost(q) * |c'|. Per strip of candidates only those whose upper bound reaches the
    k-th best so far, or the strip's k-th best lower bound, are computed exactly and offered to the heap.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    q_codes, q_step, q_lost = quantised(queries)
    q_norm = np.sqrt((queries**2).sum(axis=1))
    real = np.float32 if queries.shape[1] <= EXACT else np.float64
    for at in range(0, len(ids), STRIP):
        own_ids, own = ids[at : at + STRIP], vectors[at : at + STRIP]
        codes, step, lost = quantised(own)
        norm = np.sqrt((own**2).sum(axis=1)) + lost
        about = (q_codes.astype(real) @ codes.astype(real).T).astype(np.float64) * q_step[:, None] * step
        slack = (q_norm[:, None] * lost + q_lost[:, None] * norm) * 1.0001 + 1e-12
        low, high = about - slack, about + slack
        low[query_ids[:, None] == own_ids] = -np.inf
        sure = np.partition(low, len(own_ids) - k, axis=1)[:, len(own_ids) - k] if len(own_ids) > k else np.full(len(query_ids), -np.inf)
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        alive = (high >= np.maximum(sure, floor)[:, None]) & (query_ids[:, None] != own_ids)
        for q in range(len(query_ids)):
            picked = np.flatnonzero(alive[q])
            if not len(picked):
                continue
            scores = inner(np.broadcast_to(queries[q], (len(picked), own.shape[1])), own[picked])
            if len(picked) > k:
                best = np.lexsort((own_ids[picked], -scores))[:k]
                picked, scores = picked[best], scores[best]
            heap = heaps[q]
            for score, vec in zip(scores.tolist(), own_ids[picked].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
    return heaps


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query, exact.

    ``is_query`` is a condition on columns of ``vectors``. Rows whose vector is null, empty, zero or holds a
    null or non-finite component, and rows of null id, take no part; vectors of different lengths are not
    compared. A query does not find rows of its own id. Repeated query ids are one query, by the smallest
    vector; repeated candidates are candidates each. Ties go to the smaller id. Fewer than k candidates: all.
    Rows are dealt to blocks by a hash of the row, every query block meets every candidate block in a tile of
    bounded size, and each tile sends at most k rows a query on. Float vectors travel as floats, which tiles widen.
    Other columns are ignored.
    """
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    ready = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast(kind)).alias("v"), is_query.alias("asks")
    )
    rows = ready.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
    asked = ready.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    counts = ready.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), every(blocks).alias("cb"))
    right = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int").alias("cb"), every(query_blocks).alias("qb"))

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return schema.empty_table()
        query_ids = a["vec_id"].to_numpy()
        heaps = tile(query_ids, _matrix(a["v"]), b["vec_id"].to_numpy(), _matrix(b["v"]), k)
        found = [(int(q), -vec, score) for q, heap in zip(query_ids, heaps, strict=True) for score, vec in heap]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), schema.types, strict=True)], schema=schema)

    keys = ["dim", "qb", "cb"]
    ddl = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    best = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compare, ddl)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
