"""Request bodies, one JSON text a line, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request_id string, api string, model string, body string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON with request_id, api, model and body (body as text)."""
    return spark.read.schema(SCHEMA).json(path)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_server_ids(requests: DataFrame) -> DataFrame:
    """A fresh id for each request, whatever id the caller gave.  Write the result down before it is used twice."""
    return requests.withColumn("request_id", F.uuid())
