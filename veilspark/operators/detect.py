"""Detection: patterns over whole texts, validation, scores, and the resolution of overlaps, all inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern, Recognizer, recognizers
from . import spans as S

#: How far back context is looked for, what it adds and what a score with context is at least.
CONTEXT_TOKENS, CONTEXT_ADDS, CONTEXT_LEAST = 5, 0.35, 0.4
#: Characters before a span that are looked at first.
LOOK = 400
NER_ENTITIES, NER_SCORE = ("PERSON", "LOCATION", "ORGANIZATION"), 0.7

#: Private characters that mark a match's ends, and the one that the patterns see in place of them in a text.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"

#: Takes a table and the name of its text column; adds a column `ner_spans` of type array<span>.
NerProvider = Callable[[DataFrame, str], DataFrame]


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it that df does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _boosted(found: Column, text: Column, words: tuple[str, ...]) -> Column:
    """A context word inside one of the tokens just before a span raises its score (words are compared as written:
    there is no lemmatiser).  Where the LOOK characters before a span hold too few tokens, all before it is looked at."""
    listed = F.array(*[F.lit(w) for w in words])
    tokens = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[\w.\-]*\w"), F.lit(0))

    def near(t: Column, s: Column) -> Column:
        enough = (F.size(t) > CONTEXT_TOKENS) | (s["start"] <= LOOK)
        every = F.when(enough, t).otherwise(tokens(F.substring(text, F.lit(1), s["start"])))
        last = S.once(every, lambda x: F.slice(x, F.greatest(F.size(x) - CONTEXT_TOKENS + 1, F.lit(1)), F.lit(CONTEXT_TOKENS)))
        return F.exists(last, lambda x: F.exists(listed, lambda w: F.contains(x, w)))

    def boost(s: Column, p: Column) -> Column:
        at = F.greatest(s["start"] - p["base"] - LOOK, F.lit(0))
        has = S.once(tokens(F.substring(p["part"], at + 1, s["start"] - p["base"] - at)), lambda t: near(t, s))
        raised = F.least(F.greatest(s["score"] + CONTEXT_ADDS, F.lit(CONTEXT_LEAST)), F.lit(1.0))
        return S.span(s["entity_type"], s["start"], s["end"], F.when(has, F.round(raised, 2)).otherwise(s["score"]), s["text"])

    def block(b: Column) -> Column:
        starts = F.transform(b, lambda s: s["start"])
        base = F.greatest(F.array_min(starts) - LOOK, F.lit(0))
        part = F.struct(base.alias("base"), F.substring(text, base + 1, F.array_max(starts) - base).alias("part"))
        return S.once(part, lambda p: F.transform(b, lambda s: boost(s, p)))

    return F.when(F.size(found) > 0, F.flatten(F.transform(S.in_blocks(found), block))).otherwise(S.empty())


def _marked(text: Column, pattern: Pattern, needs: str) -> Column:
    """The text with OPEN before and CLOSE behind each match, where it can have one."""
    found = F.regexp_replace(text, F.lit(pattern.regex), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.when(text.rlike(needs), found) if needs else found


def _found(marked: Column) -> Column:
    """Places and texts of the marked matches."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(F.contains(marked, F.lit(OPEN)), S.matches(F.split(marked, f"[{OPEN}{CLOSE}]", -1))).otherwise(none)


def _of(r: Recognizer, found: list[Column], text: Column, context: bool) -> Column:
    """The recognizer's spans, out of the matches of each of its patterns."""
    parts = []
    for p, m in zip(r.patterns, found):
        valid = F.filter(m, lambda s: r.validator(s["text"])) if r.validator else m
        score = F.lit(1.0 if r.validator and not r.keeps_score else p.score)
        parts.append(F.transform(valid, lambda s: S.span(F.lit(r.entity), s["start"], s["end"], score, s["text"])))
    raises = context and r.context and (r.validator is None or r.keeps_score)
    return _boosted(F.concat(*parts), text, r.context) if raises else F.concat(*parts)


def detect(df: DataFrame, text_col: str = "text", *, out: str = "spans", entities: list[str] | None = None, score_threshold: float = 0.35, detect_bare_inn: bool = True, context: bool = True, extra: tuple[Recognizer, ...] = (), ner: NerProvider | None = None) -> DataFrame:
    """df with a column more: the disjoint spans found in its text, by place.

    Only the recognizers that `entities` asks for are built into the plan, and each pattern runs once over a text.  A
    model runs only if given, if one of its entities is asked for, and if its score can pass the threshold.  Null texts
    have no spans.  The private characters OPEN and CLOSE in a text are seen by the patterns as another private one.
    """
    text = F.col(text_col)
    wanted = None if entities is None else {e.upper() for e in entities}
    use_ner = ner is not None and score_threshold <= NER_SCORE and (wanted is None or wanted & set(NER_ENTITIES))
    model = fresh(df, "ner_spans_")
    base = df
    if use_ner:  # a column of the caller's by the model's name steps aside meanwhile
        aside = {c: fresh(df, "aside_") for c in df.columns if c.lower() == "ner_spans"}
        base = ner(df.withColumnsRenamed(aside), text_col).withColumnRenamed("ner_spans", model).withColumnsRenamed({v: k for k, v in aside.items()})
    used = recognizers(entities, detect_bare_inn=detect_bare_inn, extra=extra)
    safe, marked, places = fresh(base, "safe_"), fresh(base, "marked_"), fresh(base, "places_")
    # layers of columns: what the next one refers to more than once is not written out there again
    base = base.withColumn(safe, F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text))
    marks = [_marked(F.col(safe), p, r.needs) for r in used for p in r.patterns]
    base = base.withColumn(marked, F.array(*marks).cast("array<string>")).withColumn(places, F.transform(marked, _found))
    ordinal = iter(range(len(marks)))
    parts = [_of(r, [F.get(places, F.lit(next(ordinal))) for _ in r.patterns], text, context) for r in used]
    found = F.filter(F.concat(*parts) if parts else S.empty(), lambda s: s["score"] >= score_threshold)
    if use_ner:
        own = F.filter(F.coalesce(F.col(model), S.empty()), lambda s: F.lit(True) if wanted is None else s["entity_type"].isin(*wanted))
        resolved = S.resolve_by_score(F.concat(S.drop_contained(found), own))
    else:
        resolved = F.when(F.size(found) > 0, S.resolve(found)).otherwise(S.empty())
    spans = F.when(text.isNull(), S.empty()).otherwise(resolved)
    return base.withColumn(out, spans).drop(safe, marked, places, model)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has cores, if it has fewer: a small table in one file would keep one core
    busy with all the patterns.  A table of many files, or splits of files, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def detected_rows(df: DataFrame, id_cols: list[str], spans_col: str = "spans") -> DataFrame:
    """A row a span: the id columns, start, end, entity_type, score, text.

    The outer form, as the optimizer would put a test of the array, and with it the whole detection, below the inner one.
    """
    rows = df.select(*id_cols, F.explode_outer(spans_col).alias("s")).where(F.col("s").isNotNull())
    return rows.select(*id_cols, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.entity_type").alias("entity_type"), F.col("s.score").alias("score"), F.col("s.text").alias("text"))
