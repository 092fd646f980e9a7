"""Topics as sources and sinks: Kafka on a cluster, folders of JSON lines elsewhere; decoding with dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.schemas import TOPICS
from skeinwork.functions.urls import extract_domain

CORRUPT = "_corrupt"


def read_topic(spark: SparkSession, topic: str, folder: str | None = None, servers: str | None = None, streaming: bool = True, max_per_trigger: int | None = None, starting: str = "earliest") -> DataFrame:
    """``key, value`` (strings) of a topic: from Kafka if servers are given, else from the text files of folder/topic."""
    reader = spark.readStream if streaming else spark.read
    if servers:
        r = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
        r = r.option("maxOffsetsPerTrigger", max_per_trigger) if streaming and max_per_trigger else r
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    r = reader.option("maxFilesPerTrigger", max_per_trigger) if streaming and max_per_trigger else reader
    return r.schema("value string").text(f"{folder}/{topic}").select(F.lit(None).cast("string").alias("key"), "value")


def decode(messages: DataFrame, topic: str, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters) of a topic's messages. Rows have the topic's columns; a dead letter is ``original_message, original_topic,
    error``. Null values are dead letters as well. (The original system only logs what it cannot read.)"""
    ddl = f"{TOPICS[topic]}, {CORRUPT} string"
    parsed = messages.withColumn("__p", F.from_json(F.col(value_col), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("__p").isNull() | F.col(f"__p.{CORRUPT}").isNotNull()
    dead = parsed.filter(bad).select(F.col(value_col).alias("original_message"), F.lit(topic).alias("original_topic"), F.when(F.col(value_col).isNull(), "no value").otherwise("not readable").alias("error"))
    return parsed.filter(~bad).select("__p.*").drop(CORRUPT), dead


def event_time(ms: Column | str) -> Column:
    """Milliseconds since 1970 as timestamp in whole seconds."""
    return F.date_trunc("second", F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms))


def encode(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """``key, value`` of rows as JSON; without a key the host of their url, else their job id."""
    names = rows.columns
    default = F.coalesce(*([extract_domain("url")] if "url" in names else []), *([F.col("job_id")] if "job_id" in names else []), F.lit(None).cast("string"))
    return rows.select((key if key is not None else default).alias("key"), F.to_json(F.struct(*names)).alias("value"))


def write_topic(rows: DataFrame, topic: str, folder: str | None = None, servers: str | None = None, checkpoint: str | None = None, trigger: dict | None = None):
    """Append encoded rows to a topic; a streaming query is returned for streams (micro-batches every 5 seconds by default)."""
    out = encode(rows)
    if rows.isStreaming:
        w = (out if servers else out.select("value")).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"}))
        if servers:
            return w.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "lz4").option("topic", topic).start()
        return w.format("text").option("path", f"{folder}/{topic}").start()
    if servers:
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "lz4").option("topic", topic).save()
    else:
        out.select("value").write.mode("append").text(f"{folder}/{topic}")
    return None
