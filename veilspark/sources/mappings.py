"""The mapping store: placeholder rows with a time to live, as a table of Parquet files partitioned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: seconds that a mapping lives unless set otherwise.
DEFAULT_TTL = 3600


def with_expiry(mapping: DataFrame, created_at: Column, ttl_seconds: int = DEFAULT_TTL) -> DataFrame:
    """A time to live that is not positive counts as the default."""
    ttl = ttl_seconds if ttl_seconds > 0 else DEFAULT_TTL
    return mapping.withColumn("created_at", created_at).withColumn("expires_at", F.col("created_at") + F.make_interval(secs=F.lit(ttl)))


def save(mapping: DataFrame, path: str) -> None:
    """Appends; requests without a placeholder have no row, so nothing is saved for them."""
    mapping.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def live(mapping: DataFrame, requests: DataFrame, at: str, consumed: DataFrame | None = None) -> DataFrame:
    """requests (request_id, `at`) with the placeholders that live at that moment; without any, one row of nulls.
    consumed: requests whose mapping was deleted."""
    left = mapping.join(consumed.select("request_id").distinct(), "request_id", "left_anti") if consumed is not None else mapping
    return requests.join(left, (requests["request_id"] == left["request_id"]) & (requests[at] < left["expires_at"]) & (requests[at] >= left["created_at"]), "left").drop(left["request_id"])
