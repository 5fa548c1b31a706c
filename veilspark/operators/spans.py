"""Span algebra.  A span is struct<entity_type, start, end, score, text>; offsets are code points, end exclusive.

Arrays are worked on in blocks and clusters, so that the work grows with the spans of a text and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
SPANS = f"array<{SPAN}>"
#: Elements of an array that are folded together; an accumulator never holds more than a block.
BLOCK = 128


def empty() -> Column:
    return F.array().cast(SPANS)


def span(entity_type: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    return F.struct(entity_type.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), text.alias("text"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_blocks(items: Column) -> Column:
    """Consecutive pieces of an array, BLOCK long."""
    starts = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return once(items, lambda x: F.transform(starts(x), lambda b: F.slice(x, b, F.lit(BLOCK))))


def scan(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value, what step folds out of those before it (an array of the same size).  step must be associative."""
    fold = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, v: F.array_append(acc, step(F.element_at(acc, -1), v)))

    def join(local: Column) -> Column:
        upper = fold(F.transform(local, lambda x: F.element_at(x, -1)))
        lifted = F.zip_with(local, F.slice(upper, F.lit(1), F.size(local)), lambda x, o: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: step(o, v)))
        return F.flatten(lifted)

    return once(F.transform(in_blocks(values), fold), join)


def matches(pieces: Column) -> Column:
    """struct<start, end, text> of a pattern's matches.  pieces: the text cut at both ends of each match (gap, match, gap,
    ..., gap), so a match begins after all pieces before it.  This counts code points, which regexp_instr does not."""
    place = lambda x: scan(F.transform(x, F.length), lambda a, b: a + b, F.lit(0))
    both = lambda x: F.zip_with(x, place(x), lambda piece, at: F.struct(at.alias("start"), (at + F.length(piece)).alias("end"), piece.alias("text")))
    return F.filter(once(pieces, both), lambda x, i: i % 2 == 1)


def overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def _sorted(spans: Column, *keys) -> Column:
    """By keys, each a function of a span; what they leave open stays in the order it has."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{j}") for j, k in enumerate(keys)], i.alias("at"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda x: x["span"])


def _by_cluster(spans: Column, settle: Callable[[Column], Column]) -> Column:
    """settle() of each cluster of spans that overlap, directly or through others; clusters follow one another by place.

    Spans that don't overlap can't decide over each other.  Inside a cluster they come in the order that they had.
    """

    def clusters(x: Column) -> Column:
        reach = scan(F.transform(x, lambda s: s["span"]["end"]), lambda a, b: F.greatest(a, b), F.lit(-(2**31)))
        begins = lambda r: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["span"]["start"] >= F.get(r, i))
        cuts = once(reach, begins)
        cut = lambda c: F.transform(c, lambda b, k: F.slice(x, b + 1, F.coalesce(F.get(c, k + 1), F.size(x)) - b))
        return once(cuts, cut)

    placed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("at"), s.alias("span")))
    back = lambda c: F.transform(F.sort_array(F.transform(c, lambda x: F.struct(x["at"], x["span"]))), lambda x: x["span"])
    one = lambda c: F.when(F.size(c) == 1, F.transform(c, lambda x: x["span"])).otherwise(settle(back(c)))
    whole = lambda x: F.when(F.size(x) > 0, F.flatten(F.transform(clusters(x), one))).otherwise(empty())
    return once(F.sort_array(placed), whole)


def _keep(spans: Column, clashes) -> Column:
    """Span by span, keep what clashes with none that was kept."""
    return F.aggregate(spans, empty(), lambda kept, x: F.when(F.exists(kept, lambda k: clashes(k, x)), kept).otherwise(F.array_append(kept, x)))


def _contained(k: Column, x: Column) -> Column:
    return (k["entity_type"] == x["entity_type"]) & (k["start"] <= x["start"]) & (x["end"] <= k["end"])


def drop_contained(spans: Column) -> Column:
    """Best score first, then first, then longest: spans of one type inside a kept one go."""
    best = lambda c: _sorted(c, lambda s: -s["score"], lambda s: s["start"], lambda s: s["start"] - s["end"])
    return _by_cluster(spans, lambda c: _keep(best(c), _contained))


def resolve_by_score(spans: Column) -> Column:
    """Disjoint spans: by falling score, a span stays if it overlaps none that stayed; in order of their places."""
    return _by_cluster(spans, lambda c: _sorted(_keep(_sorted(c, lambda s: -s["score"]), overlaps), lambda s: s["start"]))


def resolve(spans: Column) -> Column:
    """drop_contained and then resolve_by_score, in one pass."""
    best = lambda c: _sorted(c, lambda s: -s["score"], lambda s: s["start"], lambda s: s["start"] - s["end"])
    return _by_cluster(spans, lambda c: _sorted(_keep(_keep(best(c), _contained), overlaps), lambda s: s["start"]))


def normalise_type(t: Column) -> Column:
    clean = F.upper(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9_]", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("PII"))


def cut_out(text: Column, spans: Column) -> Column:
    """For disjoint spans by place: struct<before, inside> each, the text since the last span and the span's own.

    Each block of spans is cut out of the text first and its spans out of that, so the text isn't walked for each span.
    """

    def block(b: Column, base: Column) -> Column:
        part = F.substring(text, base + 1, F.element_at(b, -1)["end"] - base)
        before = lambda i: F.coalesce(F.get(b, i - 1)["end"], base) - base
        piece = lambda p, s, i: F.struct(F.substring(p, before(i) + 1, s["start"] - base - before(i)).alias("before"), F.substring(p, s["start"] - base + 1, s["end"] - s["start"]).alias("inside"))
        return once(part, lambda p: F.transform(b, lambda s, i: piece(p, s, i)))

    def blocks(bs: Column) -> Column:
        return F.transform(bs, lambda b, k: block(b, F.coalesce(F.element_at(F.get(bs, k - 1), -1)["end"], F.lit(0))))

    return F.flatten(once(in_blocks(spans), blocks))


def normalise(spans: Column, text: Column) -> Column:
    """Spans from anywhere: impossible ones go, types are normalised; by place, the longer first, disjoint ones stay."""
    ends = lambda s, n: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["end"] <= n) & (s["start"] < s["end"])
    fit = once(F.length(text), lambda n: F.filter(spans, lambda s: ends(s, n)))
    ordered = lambda c: _sorted(c, lambda s: s["start"], lambda s: s["start"] - s["end"])
    first = F.struct(F.lit(0).alias("at"), empty().alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["out"], s).alias("out")))
    disjoint = _by_cluster(fit, lambda c: F.aggregate(ordered(c), first, step, lambda acc: acc["out"]))
    typed = lambda x: F.zip_with(x, cut_out(text, x), lambda s, c: span(normalise_type(s["entity_type"]), s["start"], s["end"], s["score"], c["inside"]))
    return F.when(F.size(spans) > 0, once(disjoint, typed)).otherwise(empty())
