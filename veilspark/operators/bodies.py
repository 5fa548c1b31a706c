"""Request and response bodies with their texts replaced: what was found in `targets` goes back to where it stood.

Bodies have no fixed schema and Spark has no setter for VARIANT, so the bodies that change, and only they, are rewritten
in an Arrow batch at a time by Python; numbers and order of keys stay, white space between tokens doesn't.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mask as M
from . import targets as T
from .detect import detect
from .restore import replace_placeholders

Place = tuple[dict | list, str | int]


def _listed(v) -> Iterator:
    return iter(v if isinstance(v, list) else ())


def _own(box, key) -> Iterator[Place]:
    if isinstance(box, dict) and isinstance(box.get(key), str):
        yield box, key


def _blocks(v, any_type: bool = False) -> Iterator[Place]:
    for b in _listed(v):
        if isinstance(b, dict) and (any_type or b.get("type") is None or b.get("type") in T.BLOCK_TYPES):
            yield from _own(b, "text")


def _calls(m) -> Iterator[Place]:
    for c in _listed(m.get("tool_calls")):
        if isinstance(c, dict):
            yield from _own(c.get("function"), "arguments")


def _message(m, any_type: bool = False, more: tuple[str, ...] = ()) -> Iterator[Place]:
    if not isinstance(m, dict):
        return
    yield from _own(m, "content")
    yield from _blocks(m.get("content"), any_type)
    for key in more:
        yield from _own(m, key)
    yield from _calls(m)
    yield from _own(m.get("function_call"), "arguments")


def _item(i) -> Iterator[Place]:
    if not isinstance(i, dict):
        return
    if i.get("type") in T.BLOCK_TYPES:
        yield from _own(i, "text")
    yield from _message(i)
    yield from _own(i, "arguments")
    yield from _own(i, "output")
    yield from _blocks(i.get("output"))


def request_places(body) -> Iterator[Place]:
    """Where request_targets() finds its texts, in its order."""
    if not isinstance(body, dict):
        return
    for m in _listed(body.get("messages")):
        yield from _message(m)
    for key in ("instructions", "input"):
        yield from _own(body, key)
        for i in _listed(body.get(key)):
            yield from _item(i)


def response_places(message) -> Iterator[Place]:
    """Where response_targets() finds its texts, in its order."""
    return _message(message, any_type=True, more=("reasoning_content",))


def write_back(body: Column, texts: Column, *, response: bool = False) -> Column:
    """The body with its k-th text replaced by texts[k], an array of strings in the order of the targets; null texts and
    those beyond the array stay.  A body without a replacement comes back as it is, and so does one that is no JSON."""

    @F.pandas_udf("string")
    def rewrite(bodies: pd.Series, lists: pd.Series) -> pd.Series:
        def one(text: str | None, new) -> str | None:
            if new is None or all(x is None for x in new):
                return text
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                return text
            places = list(response_places(value) if response else request_places(value))
            for (box, key), x in zip(places, new):
                if x is not None:
                    box[key] = x
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

        return pd.Series([one(b, n) for b, n in zip(bodies, lists)], dtype=object)

    return rewrite(body, texts)


def mask_bodies(requests: DataFrame, request: str, body_col: str = "body", *, out: str = "masked_body", **how) -> DataFrame:
    """requests (a row a request) with masked_body and `mapping` (array of placeholder, original, entity_type).

    how: as for detect().  Only fields in which something was found are written.  Blank fields are not looked at.
    """
    fields = T.request_targets(requests.select(request, body_col), body_col).where(F.col("target_ord").isNotNull())
    masked = M.mask_requests(detect(fields.withColumn("looked_", F.when(~T.is_blank(F.col("text")), F.col("text"))), "looked_", **how), request, "target_ord", "looked_")
    changed = F.when(F.size("mapping") > 0, F.col("masked_text"))
    per = masked.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("target_ord", changed.alias("text"))))["text"].alias("texts_"), F.flatten(F.collect_list("mapping")).alias("mapping"))
    both = requests.join(per, request, "left")
    return both.withColumn(out, write_back(F.col(body_col), F.col("texts_"))).drop("texts_")


def restore_messages(responses: DataFrame, message_col: str = "message", *, mapping_col: str = "mapping", out: str = "restored_message") -> DataFrame:
    """responses (a row a message, with its request's mapping as a map) with restored_message; nothing is shuffled."""
    texts = F.transform(T.response_texts(message_col), lambda t: t["text"])
    restored = F.transform(texts, lambda t: F.when(replace_placeholders(t, F.col(mapping_col)) != t, replace_placeholders(t, F.col(mapping_col))))
    both = responses.withColumn("texts_", F.when(F.col(mapping_col).isNotNull(), restored).otherwise(F.array().cast("array<string>")))
    return both.withColumn(out, write_back(F.col(message_col), F.col("texts_"), response=True)).drop("texts_")
