"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialise

DIM = 1 << 15  # hashed features
SAMPLE = 4000  # labelled rows that the classifier is fitted to, in expectation
VALIDATION = 0.2  # of the sample, for the temperature
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-5
UNKNOWN = "und"


def readable(text: Column) -> Column:
    """``text``, or null if no character of it is a letter (general category L)."""
    return F.when(text.rlike(r"\p{L}"), text)


def grams(text: str) -> np.ndarray:
    """The hashed 1-, 2- and 3-grams of the lower-cased text, as feature numbers with repeats."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    mixed = codes * np.uint32(0x9E3779B1)
    one = mixed ^ (mixed >> np.uint32(15))
    two = (mixed[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] + codes[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    found = np.concatenate([one, two ^ (two >> np.uint32(16)), three ^ (three >> np.uint32(16))])
    return (found & np.uint32(DIM - 1)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features present and their damped counts."""
    counts = np.bincount(grams(text), minlength=DIM)
    present = np.flatnonzero(counts)
    return present, np.log1p(counts[present])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x langs
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        return self.raw(*self.vector(text))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weighted(*features(text), self.idf)

    def raw(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; of equally likely ones the first by name. Null: a text without letters."""
        if not self.langs or text is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = tf * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, one learning rate per weight, elastic-net penalty."""

    def __init__(self, dim: int, classes: int) -> None:
        self.z = np.zeros((dim + 1, classes))
        self.n = np.zeros((dim + 1, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(texts: list[str], labels: list[str], idf: np.ndarray, langs: list[str]) -> Model:
    """Fitted to the first part of the rows; the temperature minimises the log loss on the rest."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(texts))
    held = max(1, int(len(order) * VALIDATION)) if len(order) > 4 else 0
    data = [weighted(*features(texts[i]), idf) for i in order]
    target = [langs.index(labels[i]) for i in order]
    learner = Ftrl(DIM, len(langs))
    for _ in range(EPOCHS):
        for j in rng.permutation(np.arange(held, len(order))):
            at, x = data[j]
            learner.learn(np.append(at, DIM), np.append(x, 1.0), target[j])
    w = learner.weights(np.arange(DIM + 1))
    model = Model(langs, idf, w[:DIM], w[DIM], 1.0)
    if held:
        z = np.stack([model.raw(*d) for d in data[:held]])
        grid = np.geomspace(0.02, 10, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(held), target[:held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows ``texts(text)`` has, and in how many each feature occurs. All texts count;
    tasks add up their own and DIM + 1 sums reach the driver at most."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIM + 1, dtype=np.int64)
        for part in parts:
            for text in part["text"]:
                total[:DIM] += np.bincount(grams(text), minlength=DIM) > 0
                total[DIM] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": at, "n": total[at]})

    rows = texts.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, dtype=np.int64)
    for r in rows:
        df[r["feature"]] = r["n"]
    return int(df[DIM]), df[:DIM]


def train(documents: DataFrame, may_learn: Column, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model fitted to rows of ``documents`` that satisfy ``may_learn`` and have a language and letters.

    Document frequencies and the list of languages come from all such rows, the weights from about
    ``sample`` of them per language, chosen by a hash of id and text; that bound keeps the one task that fits
    them small at any size. A language of fewer rows gives all it has.
    """
    mine = documents.where(may_learn & F.col(lang).isNotNull() & readable(F.col(text)).isNotNull())
    rows = mine.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(id_col, text).alias("mix"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), np.zeros(0), 1.0)
    langs = sorted(counts)
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(1, sample // len(langs))
    share = F.coalesce(F.create_map(*[F.lit(v) for l in langs for v in (l, min(1.0, each / counts[l]))])[F.col("lang")], F.lit(0.0))
    chosen = materialise(rows.where(F.pmod("mix", F.lit(1_000_000)) < share * 1_000_000), "language-sample")

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values(["mix", "lang"], kind="stable")
        model = fit(part["text"].tolist(), part["lang"].tolist(), idf, langs)
        at = np.flatnonzero((model.weights != 0).any(axis=1))
        yield pd.DataFrame({"feature": [-2, -1, *at], "w": [[model.temperature], model.bias.tolist(), *model.weights[at].tolist()]})

    weights, bias, temperature = np.zeros((DIM, len(langs))), np.zeros(len(langs)), 1.0
    for r in chosen.repartition(1).mapInPandas(learn, "feature long, w array<double>").collect():
        if r["feature"] == -2:
            temperature = r["w"][0]
        elif r["feature"] == -1:
            bias = np.array(r["w"])
        else:
            weights[r["feature"]] = r["w"]
    return Model(langs, idf, weights, bias, temperature)


def predictor(documents: DataFrame, model: Model):
    """A column function: text to struct(lang_pred, score). The model, DIM rows at most, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    return predict


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``documents``, from its whole text alone.

    ``lang_pred`` is a learned language, or "und" with score 0 where the text is null, empty or without a
    letter, or nothing was learned. ``score`` is the calibrated probability. Repeated rows and null ids are
    ordinary rows; an empty table gives none. Other columns are ignored.
    """
    predict = predictor(documents, model)
    return documents.select(F.col(id_col).alias("doc_id"), predict(readable(F.col(text))).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def keep_known(documents: DataFrame, model: Model, *, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``documents`` whose language is known with at least ``least`` probability, all their columns.

    Rows of null or empty text or without a letter go; repeated rows stay or go together, null ids are ordinary
    rows, an empty table stays empty.
    """
    predict = predictor(documents, model)
    judged = documents.select(F.struct(*documents.columns).alias("row"), predict(readable(F.col(text))).alias("p"))
    return judged.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
