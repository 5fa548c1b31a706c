"""Counters, histograms and alert windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histograms' buckets.
ANALYZER_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
STORE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
SIZE_BUCKETS = (1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def counts(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, buckets: tuple[float, ...], *labels: str) -> DataFrame:
    """Cumulative counts: a row a bucket (le; null is without bound) and label, with the sum and number of values."""
    per = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    agg = df.groupBy(*labels).agg(*per, F.count(value).alias("n_"), F.sum(value).alias("sum"))
    rows = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(None).cast("double").alias("le"), F.col("n_").alias("n")))
    return agg.select(*labels, F.explode(rows).alias("r"), "sum").select(*labels, "r.le", "r.n", "sum")


def quantile(df: DataFrame, q: float, *labels: str) -> DataFrame:
    """From histogram(): the value below which a share q lies, interpolated inside its bucket; beyond the last bound, that."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), "n")))
    agg = df.groupBy(*labels).agg(rows.alias("rows"))
    total = F.element_at("rows", -1)["n"]
    at = F.get(F.filter(F.transform("rows", lambda r, i: F.struct(r["n"].alias("n"), i.alias("i"))), lambda r: r["n"] >= total * q), F.lit(0))["i"]
    below_le, below_n = F.coalesce(F.get("rows", at - 1)["le"], F.lit(0.0)), F.coalesce(F.get("rows", at - 1)["n"], F.lit(0))
    le, n = F.get("rows", at)["le"], F.get("rows", at)["n"]
    value = F.when(le == float("inf"), below_le).otherwise(below_le + (le - below_le) * (total * q - below_n) / F.greatest(n - below_n, F.lit(1)))
    return agg.select(*labels, F.when(total > 0, value).alias("value"))


def rates(df: DataFrame, ts: str, *labels: str, minutes: int = 5, watermark: str | None = None) -> DataFrame:
    """Events and events a second in tumbling windows; a watermark makes this a streaming aggregate."""
    stamped = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        stamped = stamped.withWatermark(ts, watermark)
    w = F.window(ts, f"{minutes} minutes")
    return stamped.groupBy(w.alias("w"), *labels).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *labels, "n", (F.col("n") / (60.0 * minutes)).alias("per_second"))


def blocked_entities(df: DataFrame, request: str, spans_col: str = "spans") -> DataFrame:
    """(entity_type, n): what was found in requests that are blocked for it, and in how many places."""
    found = df.select(request, F.explode_outer(spans_col).alias("s")).where(F.col("s").isNotNull())
    return counts(found.select(F.col("s.entity_type").alias("entity_type")), "entity_type")


def failures(df: DataFrame, operation: str, error: str, on_failure: str = "fail_open") -> DataFrame:
    """(operation, mode, n) of the operations that failed: what failed passes on or raises by the failure mode; overload
    always raises, and a mapping that can't be deleted never does."""
    from .mask import failure_mode

    mode = F.when(F.col(error) == "overloaded", "fail_closed").when(F.col(operation) == "mapping_delete", "fail_open").otherwise(failure_mode(on_failure))
    return counts(df.where(F.col(error).isNotNull()).withColumn("mode", mode), operation, "mode")


def log_line(event: str, **fields: Column) -> Column:
    """A JSON line with sorted keys; fields must not hold texts of requests."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted({**fields, "event": F.lit(event)}.items())]))
