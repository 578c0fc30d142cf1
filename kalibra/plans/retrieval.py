"""Queries that embed, store, score and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding
from .registry import load, query


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN ' ' ELSE text END AS s FROM conversations), c AS (SELECT DISTINCT s FROM t WHERE turn = 0)
SELECT t.conv_id, t.turn, c.s IS NOT NULL AS cached, CASE WHEN c.s IS NOT NULL THEN 1 ELSE 64 END::INTEGER AS dim FROM t LEFT JOIN c ON t.s = c.s""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that the cache has (first turns, with vectors of one number here) aren't embedded again."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    text = F.coalesce("text", F.lit(""))
    sent = F.when(F.trim(text) == "", " ").otherwise(text)
    cache = turns.where("turn = 0").select(embedding.cache_key(sent, "hashed-64").alias("key"), F.array(F.lit(1.0)).alias("vector")).dropDuplicates(["key"])
    done, _ = embedding.embed_cached(turns, cache, embedding.stand_in, "hashed-64")
    return done.select("conv_id", "turn", (F.size("vector") == 1).alias("cached"), F.size("vector").alias("dim"))


@query("""SELECT a, b, score::DOUBLE AS score FROM (VALUES ('', '  ', 100), ('x', '', 0), ('Start Value', 'value', 100), ('far', 'away', 0), ('near', 'nearer', 80), ('abcd', 'bcde', 75)) v(a, b, score)""")
def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By vectors where both texts have one, held to 0 and 1; else by equal pieces; synonyms are equal."""
    rows = spark.createDataFrame([("", "  "), ("x", ""), ("Start Value", "value"), ("far", "away"), ("near", "nearer"), ("abcd", "bcde")], "a string, b string")
    vectors = spark.createDataFrame([("far", [1.0, 0.0]), ("away", [-1.0, 0.0]), ("near", [0.6, 0.8]), ("nearer", [0.0, 1.0]), ("abcd", [1.0, 0.0])], "text string, vector array<double>")
    return embedding.semantic_similarity(rows, "a", "b", vectors)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as hits of a search, their place as distance."""
    rows = load(spark, sf_dir, "conversations").where("text is not null")
    meta = F.struct(F.col("role").alias("label"), F.lit("fn").alias("function"), F.lit("1").alias("version"), F.lit("old").alias("role"))
    p = F.sort_array(F.collect_list(F.struct("turn", "text", meta.alias("m"))))
    got = rows.groupBy(F.col("conv_id").alias("query_id")).agg(p.alias("p"))
    one = lambda f: F.transform("p", lambda e: e[f])
    return embedding.flat_results(got.select("query_id", one("text").alias("documents"), one("m").alias("metadatas"), F.transform("p", lambda e: e["turn"] / 8).alias("distances")))


HITS = "h AS (SELECT conv_id AS query_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INTEGER AS rank, turn / 8.0::DOUBLE AS distance, role, text AS document FROM conversations WHERE text IS NOT NULL)"


@query(f"WITH {HITS} SELECT query_id, rank, distance::DOUBLE AS distance, role AS label, md5(document) AS document FROM h")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("query_id", "rank", "distance", "label", F.md5("document").alias("document"))


@query(f"""WITH {HITS} SELECT query_id, md5(string_agg(printf('[Chunk %d] label=%s fn=fn ver=1 role=old dist=%.4f', rank + 1, role, distance) || chr(10) || CASE WHEN length(document) > 200 THEN substr(document, 1, 200) || chr(10) || '...[truncated]' ELSE document END, chr(10) || chr(10) ORDER BY rank)) AS text
FROM h GROUP BY query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.context_report(hits(spark, sf_dir), 200).select("query_id", F.md5("text").alias("text"))


@query(f"""WITH {HITS}, b AS (SELECT query_id, role AS label, min(distance) AS distance, min(rank) AS rank FROM h GROUP BY ALL)
SELECT query_id, label, distance::DOUBLE AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, rank))::INTEGER AS place FROM b QUALIFY place <= 2""")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest hit of each label, two labels a query."""
    return embedding.top_matches(hits(spark, sf_dir), 2).select("query_id", "label", "distance", "place")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 30""")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up's bound: the first thirty rows that meet the filter."""
    return embedding.scanned(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", ["o_orderkey"], 30).select("o_orderkey")


@query("""WITH w AS (SELECT conv_id, role, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS t, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT conv_id, role, md5('New label: ' || role || chr(10) || 'Function: ' || conv_id || chr(10) || 'Meaning/context from new document:' || chr(10) || string_agg(CASE WHEN length(t) > 45 THEN rtrim(substr(t, 1, 45), ' ') || '...' ELSE t END, chr(10) ORDER BY k)) AS text
FROM w WHERE k <= 2 GROUP BY conv_id, role""")
def query_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for each label of a conversation: its first two texts, cut."""
    turns = load(spark, sf_dir, "conversations").where("text is not null and role is not null")
    chunks = turns.select(F.col("role").alias("label"), F.col("conv_id").cast("string").alias("function"), F.col("turn").alias("anchor_line"), F.col("text").alias("chunk_index"), "text")
    return embedding.query_texts(chunks, 2, 45).select(F.col("function").cast("long").alias("conv_id"), F.col("label").alias("role"), F.md5("text").alias("text"))
