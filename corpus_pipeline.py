"""A corpus pipeline over ``documents``: quality, language, repeated lines, near copies, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, other
columns of ``docs`` with them. Every stage takes whole texts of any length, rows that are repeated or have no id, and an
empty table, from which nothing comes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm import language, lines, near, packing, quality
from kalibra.llm.queries import remainder
from kalibra.llm.tables import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host's failure rate stands out, go.

    Null and empty texts fail; a null source is no host; a rate or count equal to a limit passes; repeated rows are
    judged each for itself.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no sure language go; the model learns from this stage's own input.

    Null and empty texts go, as does everything where no row has a language to learn from; of equally likely languages
    the first by name counts; a probability equal to the limit stays; repeated rows stay or go together.
    """
    return language.keep_known(docs, language.train(docs, remainder("doc_id", 4) != 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more stay in the first of them only; ``n_chars`` follows the text.

    No row goes. The first is that of the smallest id, null ids last, and in it the first such line. Null texts stay
    null; repeated rows count each, and those of the same id and text lose the same lines.
    """
    names = docs.columns
    cleaned = lines.drop_repeated(docs, min_docs=10, min_chars=1, keep_first=True)
    changed = {"text": F.when(F.col("doc.text").isNotNull(), F.col("text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return cleaned.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Rows without words or without an id stay. Rows that share an id are one document and stay or go together.
    """
    return near.keep_one(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in its sequence. Null and empty texts are the end id alone; rows that are repeated
    or have no id are documents of their own; of levels that serve equally the fullest is taken."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.with_checksum(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Language identification, exact tokens and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
