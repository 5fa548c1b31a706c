"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target fixes how often its documents are taken on average: whole times for all, and a fraction that is
an inclusion probability.  The flight phase moves the probabilities through the null-space of the constraints (number
of documents, number of words) until they are 0 or 1; blocks of a source fly apart from each other, what they leave
flies again, level by level, until at most two documents of a source are open: the landing problem.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, fresh, materialise

#: Documents of a source that fly together.
BLOCK = 4096
#: Probabilities this near to 0 or 1 have arrived.
NEAR = 1e-9


def flight(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight; at most two stay open, and sum(pi) and sum(pi * size) are kept."""
    pi = [0.0 if p <= NEAR else 1.0 if p >= 1 - NEAR else p for p in pi]
    waiting = [i for i in range(len(pi) - 1, -1, -1) if NEAR < pi[i] < 1 - NEAR]
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = active
            u = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = [1.0, -1.0]
        else:
            return pi
        up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(active, u) if x)
        down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for k, x in zip(active, u):
            pi[k] += step * x
            if pi[k] <= NEAR:
                pi[k] = 0.0
            elif pi[k] >= 1 - NEAR:
                pi[k] = 1.0
            else:
                left.append(k)
        active = left


def _fly(seed: int, level: int):
    """The flight of one block of a source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "size", "row"], kind="stable")
        rng = random.Random(f"{seed} {level} {pdf['rank'].iloc[0]} {pdf['block'].iloc[0]}")
        pdf["pi"] = flight(pdf["pi"].tolist(), pdf["size"].tolist(), rng)
        return pdf[["doc_id", "row", "size", "rank", "whole", "pi"]]

    return run


def land(pi: list[float], size: list[float], whole: bool = True) -> list[float]:
    """The open documents of a source (two at most after a flight), decided so that their words come nearest to what is
    expected of them.

    whole: each is taken or not; of choices as near, the one of fewer documents.  Otherwise the smaller ones are taken
    whole while they fit and the next one in part, so that one document at most is cut.  More than two are a caller's:
    taken whole, they are settled by falling size, each if that brings the words nearer.
    """
    want = sum(p * s for p, s in zip(pi, size))
    rising = sorted(range(len(pi)), key=lambda k: (size[k], k))
    out = [0.0] * len(pi)
    if whole and len(pi) <= 2:
        choices = [[m >> k & 1 for k in range(len(pi))] for m in range(1 << len(pi))]
        return [float(x) for x in min(choices, key=lambda c: (abs(sum(x * s for x, s in zip(c, size)) - want), sum(c), c))]
    for k in reversed(rising) if whole else rising:
        if size[k] > 0:
            out[k] = float(2 * want > size[k]) if whole else min(1.0, max(want, 0.0) / size[k])
            want -= out[k] * size[k]
    return out


def source_targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """sizes: (source, source_size, n), a row a source.  Adds rank, weight and target.

    Sources by code point, null last, take the weights in turn; together the targets are all words.  A target stops at
    `most` times its source's size; the excess goes to the others by weight until none is above: the level at which
    this ends is found from running totals over the sources in the order of size to weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level_", level).withColumn("full_", F.col("level_") * F.col("weight") > most * F.col("source_size"))
    rest = F.min(F.when(~F.col("full_"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level_"))).over(everything)["level_"]
    target = F.when(F.col("full_"), most * F.col("source_size")).otherwise(F.least(F.col("rest_") * F.col("weight"), most * F.col("source_size")))
    return leveled.withColumn("rest_", rest).withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).drop("level_", "full_", "rest_")


def mix(df: DataFrame, weights: list[float], *, most: float = 3.0, landing: str = "words", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None, seed: int = 42) -> DataFrame:
    """A row for each row of df: doc_id, size (words), source_size, target (of its source), copies (times that the whole
    document is taken, long) and taken (words taken, repeats counted, long).

    landing: the last two open documents of a source give the words that are expected of them, one of them in part
    ("words": copies counts whole copies, taken has the rest too), or are taken whole or not ("whole").  Null text: no words; such
    documents are drawn like others and add nothing.  Null sources are a source of their own, the last one.  Repeated
    rows and ids are documents of their own.  Ties are settled by a hash of the id, then id and size, so reruns agree.
    An empty table gives an empty table.

    key_col: a long that names each row, passed on as `row`; it settles what is left of ties, and null ids are dealt by it.
    """
    words = F.coalesce(F.regexp_count(col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    docs = materialise(df.select(col(id_col).cast("long").alias("doc_id"), (F.lit(0).cast("long") if key_col is None else col(key_col)).alias("row"), col(source_col).cast("string").alias("source"), words.alias("size")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = materialise(source_targets(sizes, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    keyed = docs.withColumnRenamed("source", "own_").join(sources, F.col("own_").eqNullSafe(F.col("source")))
    whole = F.floor(F.col("rate_") + NEAR)
    keyed = keyed.withColumn("rate_", rate).select("doc_id", "row", "size", "rank", whole.cast("long").alias("whole"), F.when(F.col("rate_") - whole > NEAR, F.col("rate_") - whole).otherwise(F.lit(0.0)).alias("pi"))
    schema = "doc_id long, row long, size long, rank int, whole long, pi double"
    largest = sources.agg(F.max("n")).first()[0] or 0
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    done: list[DataFrame] = []
    level, state = 0, keyed
    while True:
        blocks = -(-largest // BLOCK)

        dealt = state.withColumn("key", key).withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(max(blocks, 1))))
        flown = materialise(dealt.groupBy("rank", "block").applyInPandas(_fly(seed, level), schema))
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.where(~open_))
        state, level = flown.where(open_), level + 1
        if blocks <= 1:
            break
        largest = 2 * blocks  # each block leaves two at most

    def touch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "row"], kind="stable")
        pdf["pi"] = land(pdf["pi"].tolist(), pdf["size"].tolist(), landing == "whole")
        return pdf

    done.append(state.groupBy("rank").applyInPandas(touch, schema))
    decided = done[0]
    for part in done[1:]:
        decided = decided.unionByName(part)
    out = decided.join(sources.select("rank", "source_size", "target"), "rank")
    copies = (F.col("whole") + F.floor("pi")).cast("long")
    taken = (F.col("whole") * F.col("size") + F.round(F.col("pi") * F.col("size"))).cast("long")
    return out.select("doc_id", *(["row"] if key_col else []), "size", "source_size", "target", copies.alias("copies"), taken.alias("taken"))


def take(df: DataFrame, weights: list[float], **how) -> DataFrame:
    """df's rows, each as often as the mix takes it, all columns as they are.

    Each row is drawn by itself, also where ids repeat or are null: a row key, written down with the rows, leads back.
    """
    row, drawn, copies, copy = fresh(df, "row_", "drawn_", "copies_", "copy_")
    keyed = materialise(df.withColumn(row, F.monotonically_increasing_id()))
    mixed = mix(keyed, weights, key_col=row, landing="whole", **how).where("copies > 0").select(F.col("row").alias(drawn), F.col("copies").alias(copies))
    both = keyed.join(mixed, F.col(row) == F.col(drawn))
    columns = [col(c) for c in df.columns]
    return both.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).select(*columns)
