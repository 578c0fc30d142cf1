"""Texts to vectors: what is embedded, the cache of vectors, the store of chunks, and what is said of results.

A model is a function of a DataFrame (key, text) to (key, vector array<double>); ``match.embedded`` holds a stand-in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as tx
from ..sources import tabular
from . import extract, match

Model = Callable[[DataFrame], DataFrame]


def stand_in(texts: DataFrame) -> DataFrame:
    """(key, vector) by hashed words."""
    return texts.join(match.embedded(texts, "text"), "text").select("key", "vector")


def summary(text: Column, n: int) -> Column:
    """Spaces collapsed; what is longer than ``n`` characters is cut and ends in three points."""
    bare = tx.collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) > n, F.concat(F.rtrim(F.substring(bare, 1, n)), F.lit("..."))).otherwise(bare)


def chunk_text(label: Column, function: Column, version: Column, text: Column) -> Column:
    """What a model is given of a chunk."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    return F.concat_ws("\n", line("Label", label), line("Function", function), line("Version", version), F.coalesce(text, F.lit("")))


def query_texts(chunks: DataFrame, most: int = 4, length: int = 450) -> DataFrame:
    """(label, function, text): what a label of the new document is searched by, from its first ``most`` chunks (label,
    function, anchor_line, chunk_index, text)."""
    place = F.row_number().over(Window.partitionBy("label", "function").orderBy("anchor_line", "chunk_index"))
    few = chunks.withColumn("_k", place).where(F.col("_k") <= most)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", summary(F.col("text"), length).alias("t")))), lambda p: p["t"]), "\n")
    head = F.concat(F.lit("New label: "), "label", F.lit("\nFunction: "), "function", F.lit("\nMeaning/context from new document:\n"))
    return few.groupBy("label", "function").agg(body.alias("body")).select("label", "function", F.concat(head, "body").alias("text"))


def cache_key(text: Column, model_id: str) -> Column:
    return F.sha1(F.concat(F.lit(f"{model_id}|"), text))


def embed_cached(texts: DataFrame, cache: DataFrame, model: Model, model_id: str) -> tuple[DataFrame, DataFrame]:
    """(texts with ``vector``, the cache's new rows) of ``texts(..., text)`` and ``cache(key, vector)``.

    A text that is blank is embedded as one blank. Each distinct text that the cache lacks is embedded once; the model's
    batches and repeated calls are its own. The new rows are to be written (append) before the vectors are read, else the
    model is asked twice.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = texts.withColumn("_sent", F.when(F.trim(text) == "", " ").otherwise(text)).withColumn("_key", cache_key(F.col("_sent"), model_id))
    missing = keyed.select(F.col("_key").alias("key"), F.col("_sent").alias("text")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = model(missing)
    known = cache.select("key", "vector").unionByName(new.select("key", "vector"))
    return keyed.join(known.withColumnRenamed("key", "_key"), "_key").drop("_key", "_sent"), new


def store_chunks(blocks: DataFrame, store: DataFrame, cache: DataFrame, model: Model, model_id: str, role: str, label: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(the store with the chunks of ``blocks(block_id, name, version, line_no, line)`` put in, the cache's new rows).

    A chunk's id is the hash of its function, version, role, label and place, so that the same document replaces its rows.
    ``store`` has (id, function, version, role, label, anchor_line, chunk_index, text, vector).
    """
    names = blocks.groupBy("block_id").agg(F.first("name").alias("function"), F.first("version").alias("version"))
    cut = extract.chunks(blocks.select("block_id", "line_no", "line"), label, **limits).join(names, "block_id")
    rows = cut.select(F.sha1(F.concat_ws("|", "function", "version", F.lit(role), "label", "anchor_line", "chunk_index")).alias("id"), "function", "version", F.lit(role).alias("role"), "label", "anchor_line", "chunk_index", F.col("text").alias("body"))
    sent = rows.dropDuplicates(["id"]).withColumn("text", chunk_text(F.col("label"), F.col("function"), F.col("version"), F.col("body")))
    done, new = embed_cached(sent, cache, model, model_id)
    return tabular.upserted(store, done.withColumn("text", F.col("body")).select(*store.columns), "id"), new


def semantic_similarity(rows: DataFrame, a: str, b: str, vectors: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``score``: percent by which two texts mean the same, two decimals.

    Texts are normalised first; two empty ones are 100, one empty one 0. Where ``vectors(text, vector)`` has both texts it is
    their product held to 0 to 1, else the share of equal pieces.
    """
    said = rows.withColumns({"_a": labels.semantic(F.coalesce(a, F.lit(""))), "_b": labels.semantic(F.coalesce(b, F.lit("")))})
    none = F.lit(None).cast("array<double>")
    if vectors is None:
        said = said.withColumns({"_va": none, "_vb": none})
    else:
        for side in ("a", "b"):
            said = said.join(vectors.select(F.col("text").alias(f"_{side}"), F.col("vector").alias(f"_v{side}")), f"_{side}", "left")
    both = F.col("_va").isNotNull() & F.col("_vb").isNotNull()
    product = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), match.dot(F.col("_va"), F.col("_vb")))) * 100, 2)
    empty_a, empty_b = F.col("_a") == "", F.col("_b") == ""
    scored = said.withColumn("_text", match.text_similarity(F.when(~both & ~empty_a & ~empty_b, F.col("_a")), F.when(~both & ~empty_a & ~empty_b, F.col("_b"))))
    score = F.when(empty_a & empty_b, 100.0).when(empty_a | empty_b, 0.0).when(both, product).otherwise(F.col("_text"))
    return scored.withColumn("score", score).select(*rows.columns, "score")


def flat_results(results: DataFrame) -> DataFrame:
    """One row per hit of ``results(query_id, documents, metadatas, distances)``, whose arrays go together; the shortest ends them."""
    n = F.least(F.size("documents"), F.size("metadatas"), F.size("distances"))
    cut = lambda c: F.slice(c, F.lit(1), F.greatest(n, F.lit(0)))
    zipped = F.arrays_zip(cut(F.col("distances")).alias("distance"), cut(F.col("metadatas")).alias("meta"), cut(F.col("documents")).alias("document"))
    return results.select("query_id", F.posexplode(zipped).alias("rank", "h")).select("query_id", "rank", F.col("h.distance").cast("double").alias("distance"), "h.meta.*", F.col("h.document").alias("document"))


def context_report(hits: DataFrame, most: int = 2000) -> DataFrame:
    """(query_id, text): the hits (query_id, rank, label, function, version, role, distance, document) of a query as blocks."""
    body = F.when(F.length("document") > most, F.concat(F.substring("document", 1, most), F.lit("\n...[truncated]"))).otherwise(F.col("document"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    head = F.format_string("[Chunk %d] label=%s fn=%s ver=%s role=%s dist=%.4f\n", "n", "label", "function", "version", "role", "distance")
    rows = hits.withColumn("n", number).select("query_id", "n", F.concat(head, body).alias("t"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda p: p["t"]), "\n\n").alias("text"))


def top_matches(hits: DataFrame, n: int) -> DataFrame:
    """Of each query's hits the nearest of each label (empty labels left out), the ``n`` nearest of those, with ``place`` from 1."""
    names = [c for c in hits.columns if c not in ("query_id", "label")]
    best = hits.where(F.trim(F.coalesce("label", F.lit(""))) != "").groupBy("query_id", "label").agg(F.min_by(F.struct(*names), F.struct("distance", "rank")).alias("h")).select("query_id", "label", "h.*")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "rank"))).where(F.col("place") <= n)


def match_report(matches: DataFrame) -> DataFrame:
    """(query_id, text): the matches of ``top_matches`` as a numbered list with distance and a sample of the context."""
    line = F.format_string("%d. %s\n   distance=%.4f\n   context: %s", "place", "label", "distance", summary(F.col("document"), 260))
    rows = matches.select("query_id", "place", line.alias("t"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda p: p["t"]), "\n\n").alias("text"))


def scanned(rows: DataFrame, condition: Column, order: Sequence[str], most: int = 100_000) -> DataFrame:
    """The first ``most`` rows by ``order`` of those that meet a condition on their metadata: the bound of a look-up."""
    return rows.where(condition).orderBy(*order).limit(most)


def resolved_store(existing: Sequence[str], preferred: str) -> str:
    """The store to read: the preferred one, else the only one; an error if there is none or a choice."""
    if preferred in existing:
        return preferred
    if len(existing) == 1:
        return existing[0]
    raise LookupError(f"no store {preferred!r}; there are: {', '.join(sorted(existing)) or 'none'}")
