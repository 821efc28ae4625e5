"""Streaming queries over the events table, run to the end of the input.

State lives in checkpoints in the shared folder; each result is a Parquet table there.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tesserine.sources.scratch import shared_dir

LATE = "1 hour"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    own = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return own.withColumn("ts", F.col("ts").cast("timestamp"))


def sink(at: str):
    """Writer of batches, each into a folder of its own number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")

    return write


def result(spark: SparkSession, at: str, schema, mode: str, keys: list[str]) -> DataFrame:
    """What the batches come to: the last one of a complete query, all rows that were appended, or for each
    of ``keys`` its latest row."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", at).parquet(at)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == F.lit(last))
    if mode == "update":
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return rows.drop("batch")


def finish(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run over all input there is. ``keys``: of the rows of an update query."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")
    query = stream.writeStream.outputMode(mode).foreachBatch(sink(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return result(spark, f"{at}/out", StructType(stream.schema.fields), mode, keys or [])


def windowed(events: DataFrame, window) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    out = events.withWatermark("ts", LATE).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), total.alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def tumbling(events: DataFrame) -> DataFrame:
    return windowed(events, F.window("ts", "1 hour"))


def sliding(events: DataFrame) -> DataFrame:
    return windowed(events, F.window("ts", "2 hours", "1 hour"))


def sessions(events: DataFrame) -> DataFrame:
    """Runs of a user's events less than six hours apart."""
    out = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_each(events: DataFrame) -> DataFrame:
    """One event of each id, whatever is delivered twice within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")


def numbers(events: DataFrame) -> DataFrame:
    """Each user's counter, kept as state: purchases add one, errors take one off."""

    def step(key, batches, state: GroupState):
        value = state.get[0] if state.exists else 0
        for pdf in batches:
            value += int((pdf["event_type"] == "purchase").sum()) - int((pdf["event_type"] == "error").sum())
        state.update((value,))
        yield pd.DataFrame({"user_id": [key[0]], "value": [value]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, value long", "value long", "update", GroupStateTimeout.NoTimeout)
