"""Vector search within groups, mean vectors and one-to-one assignment."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_in_group(queries: DataFrame, vectors: DataFrame, group: str, k: int) -> DataFrame:
    """For each query (query_id, q, group) its k nearest vectors (vec_id, v) of the same group, exact, by cosine distance.

    The join is by equality on the group, so a query meets only the vectors its filter admits.
    """
    scored = queries.join(vectors, group).select("query_id", "vec_id", group, cosine_distance(F.col("q"), F.col("v")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_in_tiles(vectors: DataFrame, is_query: Column, k: int, *, among: Column | None = None, within: bool = False, per_label: bool = False, itself: bool = False, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, vec_id, label, distance, rank): for each row of ``vectors(vec_id, label, v)`` that asks its k nearest
    rows, exact, by cosine distance, ties to the smaller id.

    ``among``: only rows for which it holds may be found. ``within``: only rows of the query's label. ``per_label``: k rows of each label. ``itself``: a query may find its own
    id. Every block of queries meets every block of candidates in a tile (``within``: of the same label, whose rows make
    blocks of their own, so a query is compared with no other label), and a tile sends at most k rows a query on (and
    label). Vectors that are null, empty or zero take no part; those of different lengths are not compared.
    """
    ready = vectors.where(F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("v", lambda x: x.cast("double")).alias("v"), F.size("v").alias("dim"), is_query.alias("asks"), (F.lit(True) if among is None else F.coalesce(among, F.lit(False))).alias("answers"))
    own = [F.col("dim").alias("_dim"), *([F.col("label").alias("_label")] if within else [])]
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    sizes = written(ready.groupBy(*own).agg(cut(F.count(F.lit(1)), block).alias("blocks"), cut(F.count_if("asks"), query_block).alias("query_blocks")), "tile-sizes")
    same = (F.col("dim") == F.col("_dim")) & (F.col("label").eqNullSafe(F.col("_label")) if within else F.lit(True))
    sized = ready.join(sizes, same).drop("_dim", "_label")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    tile = F.col("label") if within else F.lit(None).cast(vectors.schema["label"].dataType)
    left = sized.where("asks").select(*[F.col(c).alias(c) for c in ("vec_id", "v", "dim")], tile.alias("of"), dealt("query_blocks").alias("qb"), every("blocks").alias("cb"))
    right = sized.where("answers").select("vec_id", "label", "v", "dim", tile.alias("of"), dealt("blocks").alias("cb"), every("query_blocks").alias("qb"))
    kind = vectors.schema["label"].dataType.simpleString()

    def matrix(t: pa.Table) -> np.ndarray:
        return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(b))
        for i in range(b.shape[1]):  # from the first component to the last, so that equal vectors are equally far
            total += a[..., i] * b[:, i]
        return total

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, query_ids, labels = b["vec_id"].to_numpy(), a["vec_id"].to_numpy(), b["label"].to_pylist()
        places: dict = {}
        for i, x in enumerate(labels):
            places.setdefault(x if per_label else None, []).append(i)
        parts = [np.array(p) for p in places.values()]
        found: tuple[list, list, list, list] = ([], [], [], [])
        if a.num_rows and b.num_rows:
            q, c = matrix(a), matrix(b)
            size = np.sqrt(inner(c, c))
            for n, own in enumerate(q):
                d = 1 - inner(own[None, :], c) / (np.sqrt(inner(own[None, :], own[None, :]))[0] * size)
                for p in parts:
                    p = p if itself else p[ids[p] != query_ids[n]]
                    for j in p[np.lexsort((ids[p], d[p]))[:k]].tolist():
                        for column, value in zip(found, (int(query_ids[n]), int(ids[j]), labels[j], float(d[j])), strict=True):
                            column.append(value)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "label": pa.array(found[2], b.schema.field("label").type), "distance": pa.array(found[3], pa.float64())})

    keys = ["dim", "of", "qb", "cb"]
    best = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compare, f"query_id long, vec_id long, label {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id", *(["label"] if per_label else [])).orderBy("distance", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vector(vectors: DataFrame, key: str, v: str, order: str) -> DataFrame:
    """Per key the element-wise mean; vectors as long as the key's first by ``order`` are added up, the others count in the divisor only."""
    sized = vectors.select(key, F.col(v).alias("v"), F.size(v).alias("n"), F.col(order).alias("_o"))
    usual = sized.groupBy(key).agg(F.min_by("n", "_o").alias("usual"), F.count(F.lit(1)).alias("rows"))
    parts = sized.select(key, "n", F.posexplode("v").alias("i", "x")).groupBy(key, "n", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    joined = parts.join(usual, key).where(F.col("n") == F.col("usual"))
    return joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("rows")).alias("m")))).alias("p")).select(key, F.transform("p", lambda e: e["m"]).alias("mean"))


def tidy(text: str | None) -> str:
    """White space collapsed, lower case; null is empty."""
    return " ".join((text or "").split()).lower()


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of both texts (spaces collapsed, lower case) in percent, two decimals; two empty texts: 100."""

    def one(x: str, y: str) -> float:
        return 100.0 if not x and not y else round(difflib.SequenceMatcher(None, x, y).ratio() * 100, 2)

    return pd.Series([one(tidy(x), tidy(y)) for x, y in zip(a, b, strict=True)], dtype=float)


def greedy_pairs(scored: DataFrame, group: str, threshold: float, few: int = 100_000) -> DataFrame:
    """One-to-one pairs within each group: the best remaining pair first (score + bonus, then ids), each side once.

    ``scored`` has group, left_id, right_id, score, bonus; pairs whose score is under the threshold consume nothing. A pair
    that is the best of both its sides is taken by the greedy order whatever else it takes, so all such pairs are taken
    at once and their sides leave; this repeats while a group has over ``few`` pairs. A group of fewer is finished in
    one task. Pairs are written once a round.
    """
    order = F.struct((-(F.col("score") + F.col("bonus"))).alias("minus"), "left_id", "right_id", "score")
    known = scored.where((F.col("score") >= threshold) & F.col("left_id").isNotNull() & F.col("right_id").isNotNull())
    pairs = written(known.select(F.col(group).alias("_g"), "left_id", "right_id", order.alias("o")), "pairs")
    taken = []
    while (pairs.groupBy("_g").count().agg(F.max("count")).first()[0] or 0) > few:
        best = {side: pairs.groupBy("_g", side).agg(F.min("o").alias("o")).select(F.col("_g").alias(f"_g_{side}"), F.col("o").alias(f"o_{side}")) for side in ("left_id", "right_id")}
        mutual = best["left_id"].join(best["right_id"], F.col("_g_left_id").eqNullSafe(F.col("_g_right_id")) & (F.col("o_left_id") == F.col("o_right_id")))
        taken.append(written(mutual.select(F.col("_g_left_id").alias("_g"), "o_left_id.left_id", "o_left_id.right_id", "o_left_id.score"), "taken"))
        for side in ("left_id", "right_id"):
            gone = taken[-1].select(F.col("_g").alias("_h"), F.col(side).alias("_side"))
            pairs = pairs.join(gone, F.col("_g").eqNullSafe(F.col("_h")) & (F.col(side) == F.col("_side")), "left_anti")
        pairs = written(pairs, "pairs")

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        rows = zip(part["minus"], part["left_id"], part["right_id"], part["score"], strict=True)
        for _, a, b, score in sorted(rows):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                kept.append((a, b, score))
        return pd.DataFrame({"_g": part["_g"].iloc[: len(kept)].reset_index(drop=True), **{c: [k[n] for k in kept] for n, c in enumerate(("left_id", "right_id", "score"))}})

    kinds = dict(scored.dtypes)
    last = pairs.select("_g", "o.*").groupBy("_g").applyInPandas(finish, f"_g {kinds[group]}, left_id {kinds['left_id']}, right_id {kinds['right_id']}, score double")
    return reduce(DataFrame.unionByName, taken, last).withColumnRenamed("_g", group)


def embedded(texts: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Each distinct text once with a unit vector of hashed words: a deterministic stand-in for a remote model."""
    import xxhash

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = []
            for t in part[text]:
                v = np.zeros(dim)
                for w in (t or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                vectors.append((v / n if n else v).tolist())
            yield pd.DataFrame({text: part[text], "vector": vectors})

    return texts.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"{text} string, vector array<double>")
