"""An extra beyond the batch operators: conversations as a stream, exact duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import conversations as C
from weftline.sources import jsonl


def read_stream(spark: SparkSession, path: str, schema: str = f"id string, ts timestamp, messages {jsonl.MESSAGES}") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def valid(stream: DataFrame) -> DataFrame:
    """Valid conversations only; stateless."""
    return stream.where(C.reject_reason(F.col("messages")).isNull())


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first conversation of each sequence of user texts, within the delay; state is dropped behind the watermark."""
    users = F.transform(C.user_texts(F.col("messages")), T.normalize_plain)
    keyed = stream.withColumn("key", T.digest(T.canonical_strings(users)))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"]).drop("key")
