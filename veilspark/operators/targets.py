"""Which texts of a request or response are looked at, and in which order.

Bodies are JSON of no fixed schema, so they are read as VARIANT and every level is tested for its type: what has an
unexpected shape is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of content blocks whose text is looked at.
BLOCK_TYPES = ("text", "input_text", "output_text")


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _items(v: Column) -> Column:
    """A list's items; of anything else, none."""
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    """[(path, text)] if v is a string, else []."""
    one = F.array(F.struct(F.lit(path).alias("path"), F.try_variant_get(v, "$", "string").alias("text")))
    return F.when(_is_string(v), one).otherwise(F.array().cast("array<struct<path:string,text:string>>"))


def _blocks(v: Column, path: str, any_type: bool = False) -> Column:
    def one(b: Column) -> Column:
        kind = _at(b, "$.type")
        fits = F.lit(True) if any_type else kind.isNull() | F.is_variant_null(kind) | (_is_string(kind) & F.try_variant_get(kind, "$", "string").isin(*BLOCK_TYPES))
        return F.when(fits, _text(_at(b, "$.text"), path)).otherwise(F.array().cast("array<struct<path:string,text:string>>"))

    return F.flatten(F.transform(_items(v), one))


def _message(m: Column, at: str) -> Column:
    content = _at(m, "$.content")
    calls = F.flatten(F.transform(_items(_at(m, "$.tool_calls")), lambda c: _text(_at(c, "$.function.arguments"), f"{at}.tool_calls.arguments")))
    return F.concat(_text(content, f"{at}.content"), _blocks(content, f"{at}.content.text"), calls, _text(_at(m, "$.function_call.arguments"), f"{at}.function_call.arguments"))


def _item(i: Column, at: str) -> Column:
    kind = _at(i, "$.type")
    explicit = _is_string(kind) & F.try_variant_get(kind, "$", "string").isin(*BLOCK_TYPES)
    own = F.when(explicit, _text(_at(i, "$.text"), f"{at}.text")).otherwise(F.array().cast("array<struct<path:string,text:string>>"))
    output = _at(i, "$.output")
    return F.concat(own, _message(i, at), _text(_at(i, "$.arguments"), f"{at}.arguments"), _text(output, f"{at}.output"), _blocks(output, f"{at}.output.text"))


def _field(body: Column, name: str) -> Column:
    v = _at(body, f"$.{name}")
    return F.concat(_text(v, name), F.flatten(F.transform(_items(v), lambda i: _item(i, name))))


def request_targets(df: DataFrame, body_col: str = "body") -> DataFrame:
    """df without its body, a row a text: target_ord (from 0), path, text.  Messages come first, then instructions, then input.

    Requests without a text have one row with null target_ord.  A body that is no JSON counts as empty.
    """
    body = F.try_parse_json(F.col(body_col))
    found = F.concat(F.flatten(F.transform(_items(_at(body, "$.messages")), lambda m: _message(m, "messages"))), _field(body, "instructions"), _field(body, "input"))
    return _rows(df, body_col, found)


def response_texts(body_col: str = "message") -> Column:
    """The texts of a response message, as an array of (path, text)."""
    m = F.try_parse_json(F.col(body_col))
    content = _at(m, "$.content")
    calls = F.flatten(F.transform(_items(_at(m, "$.tool_calls")), lambda c: _text(_at(c, "$.function.arguments"), "tool_calls.arguments")))
    return F.concat(_text(content, "content"), _blocks(content, "content.text", any_type=True), _text(_at(m, "$.reasoning_content"), "reasoning_content"), calls, _text(_at(m, "$.function_call.arguments"), "function_call.arguments"))


def response_targets(df: DataFrame, body_col: str = "message") -> DataFrame:
    """As request_targets, of a response message: content, reasoning_content, arguments of tool and function calls."""
    return _rows(df, body_col, response_texts(body_col))


def _rows(df: DataFrame, body_col: str, found: Column) -> DataFrame:
    keep = [c for c in df.columns if c != body_col]
    return df.select(*keep, F.posexplode_outer(found).alias("target_ord", "t")).select(*keep, "target_ord", F.col("t.path").alias("path"), F.col("t.text").alias("text"))


def is_blank(text: Column) -> Column:
    """Nothing but white space of any kind."""
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


# Keys of the metadata that callers may not set.
INTERNAL_KEYS = ("pii_request_id", "pii_streaming_restoration_done")


def scrub_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*INTERNAL_KEYS))


def delta_targets(df: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """Stream chunks (JSON) -> a row a text delta: choice_index (bad or missing: 0), field, delta, finish_reason."""
    c = F.try_parse_json(F.col(chunk_col))
    keep = [x for x in df.columns if x != chunk_col]
    choices = df.select(*keep, F.explode(_items(_at(c, "$.choices"))).alias("choice_"))
    index = F.coalesce(F.try_variant_get("choice_", "$.index", "int"), F.lit(0))
    fields = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.when(_is_string(_at(F.col("choice_"), f"$.delta.{f}")), F.try_variant_get("choice_", f"$.delta.{f}", "string")).alias("delta")) for f in ("content", "reasoning_content")]), lambda x: x["delta"].isNotNull())
    return choices.select(*keep, index.alias("choice_index"), F.try_variant_get("choice_", "$.finish_reason", "string").alias("finish_reason"), F.explode_outer(fields).alias("f_")).select(*keep, "choice_index", "f_.field", "f_.delta", "finish_reason")
