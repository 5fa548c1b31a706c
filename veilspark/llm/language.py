"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained with the follow-the-regularised-leader rule under an elastic net, then calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, col
from .ngrams import BUCKETS, indices, pieces

UNDETERMINED = "und"


@dataclass
class Settings:
    """per_class, longest: bounds of the labelled sample: so many documents of each language at most train the model, of
    so many characters at most each, so that no more than per_class * languages * longest characters are collected."""

    per_class: int = 600
    longest: int = 100_000
    epochs: int = 4
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    held_back: int = 5


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # (BUCKETS, classes), the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float = 1.0
    report: dict = field(default_factory=dict)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by class before the temperature, and the letters of each text."""
        sums = np.zeros((len(texts), len(self.classes)))
        total, letters = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for owner, block in pieces(texts):
            found, starts, here = indices(block)
            owner = np.array(owner)
            np.add.at(letters, owner, here)
            for index in found:
                np.add.at(total, owner, np.add.reduceat((index != 0).astype(np.float64), starts))
                for k in range(len(self.classes)):
                    np.add.at(sums[:, k], owner, np.add.reduceat(self.weights[:, k][index], starts))
        return sums / np.maximum(total, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        z, letters = self.logits([x or "" for x in texts])
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        names = [self.classes[k] if n else UNDETERMINED for k, n in zip(best, letters)]
        return names, np.where(letters > 0, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares."""
    counts = np.zeros(BUCKETS)
    for _, block in pieces([text]):
        for index in indices(block)[0]:
            counts += np.bincount(index, minlength=BUCKETS)
    counts[0] = 0
    at = counts.nonzero()[0]
    return at, counts[at] / max(counts.sum(), 1)


def train(rows: list[tuple[str, str]], s: Settings) -> Model:
    """rows: (text, language), in a fixed order.  One row in held_back fits the temperature only."""
    classes = sorted({lang for _, lang in rows})
    vectors = [(*sparse(text), classes.index(lang)) for text, lang in rows]
    vectors = [v for v in vectors if len(v[0])]
    fit = [v for i, v in enumerate(vectors) if i % s.held_back] or vectors
    held = [v for i, v in enumerate(vectors) if i % s.held_back == 0] or vectors
    df = np.zeros(BUCKETS)
    for at, _, _ in fit:
        df[at] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    k = len(classes)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias, which isn't penalised

    def weights(at: np.ndarray) -> np.ndarray:
        za, rate = z[at], (s.beta + np.sqrt(n[at])) / s.alpha
        l1 = np.where(at == BUCKETS, 0.0, s.l1)[:, None]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / (rate + s.l2))

    def features(v) -> tuple[np.ndarray, np.ndarray]:
        return np.append(v[0], BUCKETS), np.append(v[1] * idf[v[0]] * SCALE, 1.0)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(fit)):
            at, x = features(fit[i])
            w = weights(at)
            p = softmax(x @ w)
            p[fit[i][2]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1)) if fit else np.zeros((BUCKETS + 1, k))
    scores = np.array([features(v)[1] @ w[features(v)[0]] for v in held]).reshape(len(held), k)
    gold = np.array([v[2] for v in held], int)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(scores / t)[np.arange(len(gold)), gold] + 1e-12).mean() for t in grid] if len(held) else [0.0]
    model = Model(classes, (w[:BUCKETS] * idf[:, None] * SCALE).astype(np.float64), w[BUCKETS], float(grid[int(np.argmin(loss))]) if len(held) else 1.0)
    model.report = {"fit": len(fit), "held": len(held), "nonzero": int((w[:BUCKETS] != 0).sum()), "accuracy": float((scores.argmax(1) == gold).mean()) if len(held) else None}
    return model


#: Brings the shares of n-grams near 1, so that the learning rates fit.
SCALE = 30.0


def fit_language(df: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model | None:
    """Learn from the rows where `learn` holds and text and language are known; None if there are none.

    The sample is bounded by rows (see Settings): those with the smallest hash of id and text, so null and repeated ids
    are samples like others, and rows that repeat both are cut off at the bound.  Texts beyond the settings' length are
    not learned from; all are predicted.  Languages are a small set by nature; their counts come to the driver.  An empty
    table gives None.
    """
    s = settings or Settings()
    known = df.where(learn & col(lang_col).isNotNull() & (F.length(col(text_col)) <= s.longest) & (col(lang_col) != UNDETERMINED)).select(col(lang_col).alias("lang"), col(text_col).alias("text"), F.concat_ws(":", col(id_col).cast("string"), col(text_col)).alias("name"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    rows = bounded_sample(known, F.col("lang"), F.col("name"), counts, s.per_class).select("text", "lang", "spot_").collect()
    rows.sort(key=lambda r: (r[2], r[0], r[1]))
    return train([(r[0], r[1]) for r in rows], s) if rows else None


def identify(df: DataFrame, model: Model | None, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with two columns more: the language of the whole text and its calibrated probability.

    `und` with score 0 for null texts, texts without letters, and where there was nothing to learn from.  Every row is
    kept; an empty table stays empty; names that df already has are refused.
    """
    clash = {c.lower() for c in df.columns} & {lang_col.lower(), score_col.lower()}
    if clash:
        raise ValueError(f"the table already has {sorted(clash)}")
    if model is None:
        return df.withColumns({lang_col: F.lit(UNDETERMINED), score_col: F.lit(0.0)})
    schema = T.StructType([*df.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(text_col).to_pylist()) if batch.num_rows else ([], np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_col, score_col])

    return df.mapInArrow(run, schema)
