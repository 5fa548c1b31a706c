"""Named entities: from tagged tokens to spans in the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .detect import NER_ENTITIES, NER_SCORE

# A model's tags and the entities they stand for.
TAGS = {"PER": "PERSON", "PERSON": "PERSON", "LOC": "LOCATION", "LOCATION": "LOCATION", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION"}

ENTITIES = "array<struct<tag:string,parts:array<string>>>"


def merge_bio(tokens: Column, tags: Column) -> Column:
    """Entities (tag, parts) of tagged tokens: B- opens; I- of the open tag goes on, of another tag opens a new one, with
    nothing open is dropped; O and anything else closes."""
    start = F.struct(F.array().cast(ENTITIES).alias("out"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        tag = F.substring(x["tag"], F.lit(3), F.length(x["tag"]))
        opens = F.startswith(x["tag"], F.lit("B-")) | (F.startswith(x["tag"], F.lit("I-")) & acc["open"].isNotNull() & (acc["open"] != tag))
        goes_on = F.startswith(x["tag"], F.lit("I-")) & (acc["open"] == tag)
        new = F.array_append(acc["out"], F.struct(tag.alias("tag"), F.array(x["token"]).alias("parts")))
        last = F.element_at(acc["out"], -1)
        longer = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.struct(last["tag"].alias("tag"), F.array_append(last["parts"], x["token"]).alias("parts")))
        closed = F.struct(acc["out"].alias("out"), F.lit(None).cast("string").alias("open"))
        return F.when(opens, F.struct(new.alias("out"), tag.alias("open"))).when(F.coalesce(goes_on, F.lit(False)), F.struct(longer.alias("out"), acc["open"].alias("open"))).otherwise(closed)

    n = F.least(F.size(tokens), F.size(tags))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tags, F.lit(1), n), lambda a, b: F.struct(a.alias("token"), b.alias("tag")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _locate(part: Column, text: Column, start: Column) -> Column:
    """The Python function of this name takes plain values only."""
    return F.call_function("locate", part, text, start)


def align(text: Column, entities: Column, wanted: list[str] | None = None) -> Column:
    """Spans of entities in the text, one after the other: an entity is looked for, its tokens joined by spaces or by
    nothing, from where the last one ended; the earlier hit counts, at one place the longer.  Tags that stand for nothing
    are passed over; entities that are not wanted still move the search on."""
    mapped = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    start = F.struct(F.lit(0).alias("at"), S.empty().alias("out"))

    def step(acc: Column, e: Column) -> Column:
        kind = F.try_element_at(mapped, e["tag"])
        spaced, compact = F.array_join(e["parts"], " "), F.array_join(e["parts"], "")
        one, two = _locate(spaced, text, acc["at"] + 1), _locate(compact, text, acc["at"] + 1)
        use_one = (one > 0) & ((two == 0) | (one <= two))
        hit, found = F.when(use_one, one).otherwise(two), F.when(use_one, spaced).otherwise(compact)
        end = hit - 1 + F.length(found)
        fits = F.lit(True) if wanted is None else kind.isin(*[w.upper() for w in wanted])
        more = F.when(fits, F.array_append(acc["out"], S.span(kind, hit - 1, end, F.lit(NER_SCORE), found))).otherwise(acc["out"])
        moved = F.struct(end.alias("at"), more.alias("out"))
        return F.when(kind.isNull() | (F.length(compact) == 0) | (hit == 0), acc).otherwise(moved)

    return F.aggregate(entities, start, step, lambda acc: acc["out"])


def gate(score_threshold: float, wanted: list[str] | None) -> bool:
    """Whether a model can add anything to a result."""
    return score_threshold <= NER_SCORE and (wanted is None or bool({w.upper() for w in wanted} & set(NER_ENTITIES)))


def provider(load: Callable[[], Callable[[list[str]], list[tuple[list[str], list[str]]]]], wanted: list[str] | None = None):
    """A NerProvider from a model: `load` is called once in each worker and returns texts -> (tokens, tags) each.

    A batch that fails has no entities.
    """
    schema = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))])

    def run(df: DataFrame, text_col: str) -> DataFrame:
        @F.pandas_udf(schema)
        def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load()
            for texts in batches:
                try:
                    rows = model([t or "" for t in texts])
                except Exception:  # the patterns' results stand without the model's
                    rows = [([], []) for _ in texts]
                yield pd.DataFrame({"tokens": [list(a) for a, _ in rows], "tags": [list(b) for _, b in rows]})

        tagged = df.withColumn("tagged_", tag(F.col(text_col)))
        entities = merge_bio(F.col("tagged_.tokens"), F.col("tagged_.tags"))
        return tagged.withColumn("ner_spans", align(F.col(text_col), entities, wanted)).drop("tagged_")

    return run
