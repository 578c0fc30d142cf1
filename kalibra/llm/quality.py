"""Quality rules: per-document base rules and host-level verdicts with an empirical beta prior."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialise
from .words import WORD, words

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = re.compile(r"[#*$%&|<>]")
_WINDOW_DOUBLINGS = 3  # windows of 2**3 words


def repeated_words(tokens: list[str]) -> int:
    """How many words lie in an 8-word window that occurs at least twice in ``tokens``.

    Window identity is exact: ids of words are paired three times (1 -> 2 -> 4 -> 8 words), each pair
    getting the number of its first equal.
    """
    n, width = len(tokens), 1 << _WINDOW_DOUBLINGS
    if n <= width:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int64, count=n)
    span = 1
    for _ in range(_WINDOW_DOUBLINGS):
        pairs = ids[: len(ids) - span] * np.int64(n + 1) + ids[span:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span *= 2
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five metrics of one text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = words(text)
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += WORD.search(line) is not None
        else:
            seen.add(line)
    return len(tokens), sum(map(len, tokens)), len(_SYMBOL.findall(text)), repeats, repeated_words(tokens)


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))
def metrics(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([measure(t) for t in texts], columns=METRICS, dtype="int64")


def base_failed(m: str = "m", min_words: int = 20, max_repeat_percent: int = 30):
    return (F.col(f"{m}.n_words") < min_words) | (100 * F.col(f"{m}.n_repeat_words") > max_repeat_percent * F.col(f"{m}.n_words"))


def host_verdicts(judged: DataFrame, host: str, least_rate: float, max_rate: float, deviations: float) -> DataFrame:
    """Hosts with their shrunk failure rate: (host, host_docs, host_rate, host_ok).

    The prior Beta(a, b) is fitted to all hosts' rates by moments; only its two numbers pass through the
    driver. A host's rate is (failures + a) / (documents + a + b), so that a host of few documents stays near
    the corpus' rate. A host is bad if that rate stands out from the prior: above its mean by more than
    ``deviations`` of its standard deviations (1.645: its 95th percentile, about). That limit is at least
    ``least_rate``, so that hosts of clean documents never go, and at most ``max_rate``. Documents without a
    host get no verdict.
    """
    hosts = materialise(
        judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
        "hosts",
    )
    rate = F.col("host_failed") / F.col("host_docs")
    p = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("host_docs").alias("docs"),
        F.sum("host_failed").alias("failed"),
        F.var_pop(rate).alias("var"),
        F.avg(1 / F.col("host_docs")).alias("inverse"),
    ).first()
    a, b = beta_prior(p["failed"] or 0, p["docs"] or 0, p["var"] or 0.0, p["inverse"] or 1.0)
    limit = min(max_rate, max(least_rate, a / (a + b) + deviations * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5))
    shrunk = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.select(F.col(host), "host_docs", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok"))


def beta_prior(failed: int, docs: int, variance: float, inverse: float) -> tuple[float, float]:
    """Beta parameters from the pooled rate and the spread of host rates beyond binomial noise."""
    mean = (failed + 0.5) / (docs + 1.0)
    noise = mean * (1 - mean) * inverse
    spread = max(variance - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def judge(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", host: str = "source", least_rate: float = 0.2, max_rate: float = 0.5, deviations: float = 1.645
) -> DataFrame:
    """One row per row of ``documents`` with its metrics, base verdict, host rate and final verdict.

    Null or empty text: all metrics 0, base rule failed. Null host: only the base rule decides. Repeated rows
    are judged separately, each counts for its host. A rate equal to the limit passes. Texts are measured whole,
    however long. Other columns of ``documents`` are ignored. An empty table gives an empty result.
    """
    judged = materialise(
        documents.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), metrics(F.col(text)).alias("m"))
        .select("doc_id", "host", "m.*", base_failed().alias("base_failed")),
        "quality",
    )
    verdicts = host_verdicts(judged, "host", least_rate, max_rate, deviations)
    return judged.join(verdicts, "host", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))


def keep_good(documents: DataFrame, *, text: str = "text", host: str = "source", least_rate: float = 0.2, max_rate: float = 0.5, deviations: float = 1.645) -> DataFrame:
    """The rows of ``documents`` that pass both verdicts of ``judge``, all their columns as they are.

    Rows of null or empty text go, rows of null host stay if they pass the base rule, repeated rows stay or go
    together, an empty table stays empty. Rows and verdicts are written once; host rates read two columns of them.
    """
    judged = materialise(
        documents.select(F.struct(*documents.columns).alias("row"), F.col(host).alias("host"), metrics(F.col(text)).alias("m"))
        .select("row", "host", base_failed().alias("base_failed")),
        "quality-rows",
    )
    bad = host_verdicts(judged, "host", least_rate, max_rate, deviations).where(~F.col("host_ok")).select("host")
    return judged.where(~F.col("base_failed")).join(bad, "host", "left_anti").select("row.*")
