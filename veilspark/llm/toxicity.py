"""Toxicity by a weighted lexicon: folded text is matched by an Aho-Corasick automaton.

The lexicon's terms, their weights, the exception phrases and the scale of the score are all learned from labelled
documents.  Folding keeps one character for one character, so a match can be checked against the text it came from.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, col

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвекмнорстухіјѕԁһԛԝӏαβεικνορτυχѵɡɩʟ", "abbekmhopctyxijsdhqwlabeikvoptuxvgil"))
#: Digits and signs that stand for letters.
SUBSTITUTES = dict(zip("013457@$", "oieastas"))

#: Marks the end of a word in a term.
END = "\n"

WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*", re.UNICODE)


class _Fold(dict):
    """Code point -> code point: lower case, no accent, Latin letter for its look-alike, letter for its substitute."""

    def __missing__(self, c: int) -> int:
        x = chr(c).lower()
        x = x if len(x) == 1 else chr(c)
        x = HOMOGLYPHS.get(x, x)
        base = unicodedata.normalize("NFKD", x)[:1]
        x = base if base.isascii() and base.isalnum() else x
        x = HOMOGLYPHS.get(x, x)
        self[c] = ord(SUBSTITUTES.get(x, x))
        return self[c]


@lru_cache(1)
def folding() -> _Fold:
    return _Fold()


def fold(text: str) -> str:
    return text.translate(folding())


def words_of(text: str) -> list[str]:
    """Folded words; a word of digits only is none."""
    return [fold(w) for w in WORD.findall(text) if not w.isdigit()]


@dataclass
class Settings:
    """per_label, longest: bounds of the labelled sample: so many documents of each label at most are learned from, of so
    many characters at most each, so that no more than 2 * per_label * longest characters are collected."""

    per_label: int = 2500
    longest: int = 100_000
    least_documents: int = 6
    certainty: float = 30.0  # least G statistic of a term
    least_odds: float = 1.5
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)  # lengths of beginnings of words that may be terms
    at: float = 0.7


@dataclass
class Model:
    terms: dict[str, float]  # beginnings of words, or whole words with END behind them
    exceptions: set[str] = field(default_factory=set)
    scale: tuple[float, ...] = (-4.0, 1.0, 1.0)
    report: dict = field(default_factory=dict)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, _automaton=None)

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for x in self.terms:  # a whole word and a stem may be spelled alike
                a.add_word(x.rstrip(END), (x.rstrip(END), [t for t in (x.rstrip(END), x.rstrip(END) + END) if t in self.terms], False))
            for x in self.exceptions:
                a.add_word(x, (x, [x], True))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> list[str]:
        """Terms that words of the text begin with or are, but for those inside an exception phrase."""
        if not self.terms:
            return []
        folded = fold(text)
        found, excused = [], []
        for end, (x, terms, phrase) in self.automaton.iter(folded):
            a, b = end + 1 - len(x), end + 1
            if a and text[a - 1].isalnum():
                continue
            ended = b == len(text) or not text[b].isalnum()
            if phrase:
                if ended:
                    excused.append((a, b, x))
            else:
                found += [(a, b, t) for t in terms if ended or not t.endswith(END)]
        if excused:
            found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in excused)]
        return [x for _, _, x in found]

    def features(self, text: str) -> tuple[float, float]:
        """Weight of the hits in all (by its logarithm), and for each hundred characters."""
        total = sum(self.terms[x] for x in self.hits(text))
        return math.log1p(total), math.log1p(100 * total / max(len(text), 100))

    def score(self, text: str | None) -> float:
        a, b = self.features(text or "")
        z = self.scale[0] + self.scale[1] * a + self.scale[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _one_of_each(rows: list[tuple[str, int]]) -> list[tuple[list[str], str, int]]:
    """Rows as (words, text, label), copies and most near copies left out: of rows with one smallest shingle, one."""
    seen, out = set(), []
    for text, label in rows:
        w = words_of(text)
        shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
        keys = {(k, min(zlib.crc32(s.encode("utf-8", "surrogatepass"), k) for s in shingles)) for k in (1, 2)}
        if not keys & seen:
            out.append((w, text, label))
        seen |= keys
    return out


def train(rows: list[tuple[str, int]], s: Settings) -> Model:
    """rows: (text, label 0 or 1), in a fixed order."""
    kept = _one_of_each(rows)
    n = Counter(label for _, _, label in kept)
    if not n[0] or not n[1]:
        return Model({}, scale=(-4.0 if not n[1] else 4.0, 0.0, 0.0), report={"documents": dict(n)})

    def units(w: list[str]) -> set[str]:
        words = {x for x in w if len(x) > 2}
        return {x + END for x in words} | {x[:k] for x in words for k in s.stems if k <= len(x)}

    seen = [Counter(), Counter()]
    for w, _, label in kept:
        if label:
            seen[1].update(units(w))
    maybe = {x for x, a in seen[1].items() if a >= s.least_documents}
    for w, _, label in kept:
        if not label:
            seen[0].update(units(w) & maybe)

    def judged(x: str) -> tuple[float, float]:
        """Log-odds of the label, and the G statistic of term against label."""
        a, b = seen[1][x], seen[0][x]
        lo = math.log((a + 0.5) / (n[1] - a + 0.5)) - math.log((b + 0.5) / (n[0] - b + 0.5))
        share = (a + b) / (n[0] + n[1])
        cells = [(a, n[1] * share), (b, n[0] * share), (n[1] - a, n[1] * (1 - share)), (n[0] - b, n[0] * (1 - share))]
        return lo, 2 * sum(o * math.log(o / e) for o, e in cells if o and e)

    terms: dict[str, float] = {}
    ranked = sorted(((*judged(x), x) for x in maybe), key=lambda v: (-round(v[1], 6), -len(v[2]), v[2]))
    for lo, sure, x in ranked:
        if lo < s.least_odds or sure < s.certainty:
            continue
        stem = x.rstrip(END)
        if any(t.rstrip(END).startswith(stem) or (not t.endswith(END) and stem.startswith(t)) for t in terms):
            continue  # a term that is surer says it already
        terms[x] = round(lo, 4)
    # a phrase of a term and a neighbour is an exception if it stands in clean documents far more than chance has it
    stems = tuple(t for t in terms if not t.endswith(END))
    is_term = lambda x: x + END in terms or x.startswith(stems)
    phrases, clean = Counter(), Counter()
    for w, _, label in kept:
        pairs = {f"{x} {y}" for x, y in zip(w, w[1:]) if is_term(x) or is_term(y)}
        phrases.update(pairs)
        if label == 0:
            clean.update(pairs)
    exceptions = {p for p, k in clean.items() if k >= s.least_documents and k >= 0.95 * phrases[p]}
    model = Model(terms, exceptions)
    x = np.array([(1.0, *model.features(t)) for _, t, _ in kept])
    y = np.array([label for _, _, label in kept], float)
    beta = np.zeros(3)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.scale = tuple(float(v) for v in beta)
    p = 1 / (1 + np.exp(-(x @ beta)))
    model.report = {"documents": dict(n), "terms": len(terms), "exceptions": len(exceptions), "caught": float((p[y == 1] >= s.at).mean()), "false": float((p[y == 0] >= s.at).mean())}
    return model


def fit_toxicity(df: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Model:
    """Learn from the rows where `learn` holds and text and label are known.

    The sample is bounded by rows (see Settings).  First come labels: of each, 1.5 * per_label ids of the smallest hash,
    which are broadcast; ids that repeat with one label count once.  Then documents: per_label rows of each label, again
    by hash, so that ids which repeat in the documents don't widen the sample.  Null ids match nothing.  Texts beyond the
    settings' length are not learned from; all are scored.  Without documents of both labels no term is learned.
    """
    s = settings or Settings()
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).alias("id_"), col(label_col).cast("int").alias("y_")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y_").count().collect()}
    chosen = bounded_sample(known, F.col("y_"), F.col("id_").cast("string"), counts, s.per_label * 3 // 2).select("id_", "y_")
    texts = df.where(learn & (F.length(col(text_col)) <= s.longest)).select(col(id_col).alias("own_"), col(text_col).alias("text_"))
    both = texts.join(F.broadcast(chosen), F.col("own_") == F.col("id_"))
    name = F.concat_ws(":", F.col("id_").cast("string"), F.col("text_"))
    rows = bounded_sample(both, F.col("y_"), name, dict.fromkeys(counts, 1), s.per_label).select("text_", "y_", "spot_").collect()
    rows.sort(key=lambda r: (r[2], r[0], r[1]))
    return train([(r[0], r[1]) for r in rows], s)


def toxicity(df: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted", at: float = 0.7) -> DataFrame:
    """df with two columns more: the score of the whole text (0 to 1) and 1 where it is `at` or more, else 0.

    Null counts as empty; an empty text has the score of no hits.  Every row is kept; an empty table stays empty; names
    that df already has are refused.
    """
    clash = {c.lower() for c in df.columns} & {score_col.lower(), predicted_col.lower()}
    if clash:
        raise ValueError(f"the table already has {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # a lexicon learned from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x.as_py()) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= at) for x in scores], pa.int32())], names=[*batch.schema.names, score_col, predicted_col])

    return df.mapInArrow(run, schema)
