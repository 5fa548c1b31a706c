"""Which deployment answers a request, and who may ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allowed_models(keys: DataFrame, deployments: DataFrame) -> DataFrame:
    """(key, deployment) pairs that share an access group.

    Groups are exploded and joined by equality, so neither side is compared with all of the other.
    """
    own = keys.select("key_id", F.explode("groups").alias("g"))
    offered = deployments.select("deployment_id", "model_name", F.explode("access_groups").alias("g"))
    return own.join(offered, "g").select("key_id", "deployment_id", "model_name").distinct()


def with_access(requests: DataFrame, keys: DataFrame, deployments: DataFrame) -> DataFrame:
    """Requests whose key may use their model."""
    return requests.join(allowed_models(keys, deployments).select("key_id", "model_name").distinct(), ["key_id", "model_name"], "left_semi")


def unknown_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests that show no known key."""
    return requests.join(keys.select("key_id"), "key_id", "left_anti")


def sticky(requests: DataFrame, deployments: DataFrame, affinity: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """requests (request_id, key_id, model_name, ts) with deployment_id: the one that the key used within the time to
    live, if it is healthy, else one picked by a hash of key and deployment."""
    healthy = deployments.where("healthy").select("model_name", "deployment_id")
    last = affinity.join(healthy, ["model_name", "deployment_id"], "left_semi").groupBy("key_id", "model_name").agg(F.max_by("deployment_id", "used_at").alias("last"), F.max("used_at").alias("used_at"))
    pairs = requests.select("key_id", "model_name").distinct().join(healthy, "model_name")
    rank = F.row_number().over(Window.partitionBy("key_id", "model_name").orderBy(F.md5(F.concat_ws("|", F.col("key_id").cast("string"), F.col("deployment_id")))))
    picked = pairs.withColumn("r", rank).where("r = 1").select("key_id", "model_name", F.col("deployment_id").alias("picked"))
    both = requests.join(last, ["key_id", "model_name"], "left").join(picked, ["key_id", "model_name"], "left")
    fresh = F.col("last").isNotNull() & (F.col("ts") <= F.col("used_at") + F.make_interval(secs=F.lit(ttl_seconds)))
    return both.withColumn("deployment_id", F.when(fresh, F.col("last")).otherwise(F.col("picked"))).withColumn("sticky", F.coalesce(fresh, F.lit(False))).select(*requests.columns, "deployment_id", "sticky")


def guarded(requests: DataFrame, name: str, default_on: bool) -> DataFrame:
    """Requests that the guardrail `name` applies to: all if it is on by default, else those that list it."""
    return requests if default_on else requests.where(F.coalesce(F.array_contains("guardrails", name), F.lit(False)))
