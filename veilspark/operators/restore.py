"""Restoring originals in responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What the masking operators make, and an opening of one that another "<" interrupts.
PLACEHOLDER, INTERRUPTED = "<[A-Za-z0-9_]+_[0-9]+>", "<[A-Za-z0-9_]*<"


def replace_placeholders(text: Column, mapping: Column) -> Column:
    """Literal replacement one placeholder after another, the longest first (of one length, by name).

    Where placeholders have the form <TYPE_n>, no original holds "<" and no "<" of the text runs into a placeholder, no
    replacement can make or break another: then one pass over the text does the same.
    """
    entries = F.transform(F.map_entries(mapping), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    in_turn = F.aggregate(F.array_sort(entries), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))
    apart = F.forall(F.map_entries(mapping), lambda e: e["key"].rlike(f"^{PLACEHOLDER}$") & ~F.contains(e["value"], F.lit("<"))) & ~text.rlike(INTERRUPTED)
    found, gaps = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.split(text, PLACEHOLDER, -1)
    at_once = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.try_element_at(mapping, m), m, F.lit("")))), "")
    none = mapping.isNull() | (F.size(mapping) == 0) | ~F.contains(text, F.lit("<")) & F.forall(F.map_keys(mapping), lambda k: F.startswith(k, F.lit("<")))
    return F.when(none, text).when(apart, at_once).otherwise(in_turn)


def entity_of(placeholder: Column) -> Column:
    """<TYPE_n> -> TYPE."""
    return F.regexp_extract(placeholder, r"^<(.*)_\d+>$", 1)


def as_maps(mapping: DataFrame, request: str) -> DataFrame:
    """Mapping rows -> (request, mapping)."""
    return mapping.groupBy(request).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("mapping"))


def restore(responses: DataFrame, mapping: DataFrame, request: str, text_col: str = "text") -> DataFrame:
    """responses (a row a field) with restored_text; requests without a mapping keep their text."""
    return responses.join(as_maps(mapping, request), request, "left").withColumn("restored_text", replace_placeholders(F.col(text_col), F.col("mapping"))).drop("mapping")


def with_request_maps(masked: DataFrame, request: str, mapping_col: str = "mapping") -> DataFrame:
    """Rows of mask_requests(), whose mapping is that of a field, with the whole request's as a map: no shuffle more."""
    pairs = F.flatten(F.collect_list(mapping_col).over(Window.partitionBy(request)))
    return masked.withColumn(mapping_col, F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["placeholder"], p["original"]))))


def response_outcomes(fields: DataFrame, request: str, *, text_col: str = "text", restored_col: str = "restored_text") -> DataFrame:
    """(request, result, delete_mapping) of each response.

    fields: a row a field with request (null: none known), has_mapping, load_failed, supported, stream, stream_done.
    """
    agg = fields.groupBy(request).agg(
        F.max("has_mapping").alias("has"), F.max("load_failed").alias("failed"), F.min("supported").alias("supported"),
        F.max(F.col("stream") & (F.col("stream_done") | ~F.col("supported"))).alias("streamed"),
        F.max(~F.col(text_col).eqNullSafe(F.col(restored_col))).alias("changed"),
    )
    result = (
        F.when(F.col(request).isNull() | F.col("streamed"), "skipped")
        .when(F.col("failed"), "error")
        .when(~F.col("has"), "no_mapping")
        .when(~F.col("supported"), "unsupported_response")
        .when(F.col("changed"), "restored")
        .otherwise("no_placeholders")
    )
    return agg.withColumn("result", result).select(request, "result", F.col("result").isin("restored", "no_placeholders").alias("delete_mapping"))
