"""Masking: request-scoped placeholders, splicing, blocking, and the outcome of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans as S


#: A span's replacement.
REPLACED = "array<struct<start:int,end:int,placeholder:string>>"


def _placeholder(entity: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), entity, F.lit("_"), n.cast("string"), F.lit(">"))


def number_placeholders(df: DataFrame, request: str, order: str, spans_col: str = "spans") -> DataFrame:
    """A row a span with its placeholder <TYPE_n>: n runs over the whole request by type, in the order of its fields and
    then from left to right; equal values get numbers of their own.  One shuffle, by request."""
    flat = df.select(request, order, F.explode_outer(spans_col).alias("s")).where(F.col("s").isNotNull()).select(request, order, "s.*")
    n = F.row_number().over(Window.partitionBy(request, "entity_type").orderBy(order, "start"))
    return flat.repartition(F.col(request)).withColumn("placeholder", _placeholder(F.col("entity_type"), n))


def splice(text: Column, replaced: Column) -> Column:
    """text with spans (struct<start, end, placeholder>, disjoint, by place) replaced."""

    def joined(r: Column) -> Column:
        head = F.array_join(F.zip_with(S.cut_out(text, r), r, lambda c, s: F.concat(c["before"], s["placeholder"])), "")
        return F.concat(head, F.substring(text, F.element_at(r, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(replaced) > 0, S.once(replaced, joined)).otherwise(text)


def mask(df: DataFrame, request: str, order: str, text_col: str = "text", spans_col: str = "spans") -> tuple[DataFrame, DataFrame]:
    """(df with masked_text, mapping rows (request, placeholder, original, entity_type)).

    A field is told by request and order.  Spans go through normalise() first, so those from outside are safe too.
    """
    ready = df.withColumn(spans_col, S.normalise(F.coalesce(F.col(spans_col), S.empty()), F.col(text_col)))
    numbered = number_placeholders(ready, request, order, spans_col)
    per_field = numbered.groupBy(request, order).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("replaced_"))
    masked = ready.join(per_field, [request, order], "left").withColumn("masked_text", splice(F.col(text_col), F.coalesce("replaced_", F.array().cast(REPLACED)))).drop("replaced_")
    mapping = numbered.select(request, "placeholder", F.col("text").alias("original"), "entity_type")
    return masked, mapping


def mask_requests(df: DataFrame, request: str, order: str, text_col: str = "text", spans_col: str = "spans", out: str = "masked_text") -> DataFrame:
    """df with masked_text, and in `mapping` what was replaced in this field: one shuffle, by request, for both.

    Placeholders are numbered as number_placeholders() does: of each type, a field goes on after the spans of the
    request's earlier fields.  Rows of one request and order are told apart by nothing, so orders must be unique.
    """
    ready = df.withColumn(spans_col, S.normalise(F.coalesce(F.col(spans_col), S.empty()), F.col(text_col)))
    types = F.transform(spans_col, lambda s: s["entity_type"])
    kinds = F.transform(F.array_distinct(types), lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n")))
    before = F.flatten(F.collect_list("kinds_").over(Window.partitionBy(request).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    numbered = ready.withColumn("kinds_", kinds).withColumn("before_", before)

    def replacements(spans: Column) -> Column:
        """By type, the spans numbered after those of earlier fields; then by place."""

        def of(t: Column) -> Column:
            sofar = F.aggregate(F.filter("before_", lambda k: k["type"] == t), F.lit(0), lambda acc, k: acc + k["n"])
            own = F.filter(spans, lambda s: s["entity_type"] == t)
            return S.once(sofar, lambda m: F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), _placeholder(t, i + m + 1).alias("placeholder"))))

        return F.array_sort(F.flatten(F.transform(F.transform("kinds_", lambda k: k["type"]), of)))

    out_ = numbered.withColumn("replaced_", F.when(F.size(spans_col) > 0, replacements(F.col(spans_col))).otherwise(F.array().cast(REPLACED)))
    out_ = out_.withColumn(out, splice(F.col(text_col), F.col("replaced_")))
    pairs = F.zip_with("replaced_", spans_col, lambda r, s: F.struct(r["placeholder"].alias("placeholder"), s["text"].alias("original"), s["entity_type"].alias("entity_type")))
    return out_.withColumn("mapping", pairs).drop("kinds_", "before_", "replaced_")


def mask_rows(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Where each row is a request of one field: masked_text and the mapping, without a shuffle."""
    text = F.col(text_col)
    out = df.withColumn("ready_", S.normalise(F.coalesce(F.col(spans_col), S.empty()), text))

    def of(t: Column) -> Column:
        own = F.filter("ready_", lambda s: s["entity_type"] == t)
        return F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), _placeholder(t, i + 1).alias("placeholder")))

    replaced = F.array_sort(F.flatten(F.transform(F.array_distinct(F.transform("ready_", lambda s: s["entity_type"])), of)))
    out = out.withColumn("replaced_", F.when(F.size("ready_") > 0, replaced).otherwise(F.array().cast(REPLACED)))
    out = out.withColumn("masked_text", splice(text, F.col("replaced_")))
    entries = F.zip_with("replaced_", "ready_", lambda r, s: F.struct(r["placeholder"], s["text"]))
    return out.withColumn("mapping", F.map_from_entries(entries)).drop("ready_", "replaced_")


def policy(name: str | None) -> str:
    """mask or block; spelled with spaces, capitals or dashes too; what is unknown masks."""
    key = (name or "").strip().lower().replace("-", "_")
    return key if key in ("mask", "block") else "mask"


def failure_mode(name: str | None) -> str:
    key = (name or "").strip().lower().replace("-", "_")
    return key if key in ("fail_open", "fail_closed") else "fail_open"


def block_verdicts(df: DataFrame, request: str, spans_col: str = "spans") -> DataFrame:
    """(request, blocked, entities, n_spans): a request with any span is blocked; it names its types, sorted, and no text."""
    return df.groupBy(request).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(spans_col, lambda s: s["entity_type"]))))).alias("entities"), F.sum(F.size(spans_col)).alias("n_spans")).withColumn("blocked", F.col("n_spans") > 0)


def blocked_error(entities: Column) -> Column:
    """The answer to a blocked request."""
    return F.when(F.size(entities) > 0, F.struct(F.lit(422).alias("status"), F.lit("pii_detected").alias("type"), F.lit("pii_blocked").alias("code"), entities.alias("entities")))


def request_outcomes(fields: DataFrame, request: str, order: str, *, mode: str = "mask", on_failure: str = "fail_open", save_failed: str | None = None) -> DataFrame:
    """(request, result, action) of each request.

    fields: a row a field with `order` (null: the request has no field), n_spans, and `error` (null, 'overloaded' or
    'failed').  The first field that fails decides: overload always raises; when blocking, spans found in an earlier field
    block; else the failure passes the request on unchanged or raises, by on_failure.  save_failed names a boolean column:
    the mapping could not be saved, which fails a request that would have been masked.
    """
    w = Window.partitionBy(request)
    failed_at = F.min(F.when(F.col("error").isNotNull(), F.col(order))).over(w)
    looked = fields.withColumn("failed_at_", failed_at)
    before = F.col("failed_at_").isNull() | (F.col(order) < F.col("failed_at_"))
    agg = looked.groupBy(request).agg(
        F.count(order).alias("n"),
        F.coalesce(F.sum(F.when(before, F.col("n_spans"))), F.lit(0)).alias("found"),
        F.max(F.when(F.col(order) == F.col("failed_at_"), F.col("error"))).alias("error"),
        (F.coalesce(F.max(save_failed), F.lit(False)) if save_failed else F.lit(False)).alias("unsaved"),
    )
    blocking = F.lit(policy(mode) == "block")
    masked = (F.col("found") > 0) & ~blocking
    result = (
        F.when(F.col("n") == 0, "skipped")
        .when(F.col("error") == "overloaded", "error")
        .when(blocking & (F.col("found") > 0), "blocked")
        .when(F.col("error").isNotNull() | (masked & F.col("unsaved")), "error")
        .when(masked, "masked")
        .otherwise("clean")
    )
    action = (
        F.when((F.col("result") == "error") & (F.col("error").eqNullSafe("overloaded") | F.lit(failure_mode(on_failure) == "fail_closed")), "reject")
        .when(F.col("result") == "blocked", "reject")
        .when(F.col("result") == "masked", "send_masked")
        .otherwise("send_unchanged")
    )
    return agg.withColumn("result", result).withColumn("action", action).select(request, "result", "action")
