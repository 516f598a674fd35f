"""The recent store as a stream: new items as they are written, and windowed aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Metric
from ..operators.unified import expand, resolve
from ..sources.archive import TIMESTAMP
from ..sources.nearline import KEY, SORT, partition_key


def read(spark: SparkSession, folder: str, schema, metric: Metric) -> DataFrame:
    """The metric's events of items that arrive as Parquet files in folder."""
    items = spark.readStream.schema(schema).parquet(folder).where(F.col(KEY) == partition_key(metric))
    return resolve(expand(items).withColumnRenamed(SORT, TIMESTAMP), metric, hidden=(KEY,))


def tumbling(events: DataFrame, width: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates over windows of width; rows later than `late` are left out."""
    timed = events.withColumn("_at", F.timestamp_millis("timestamp")).withWatermark("_at", late)
    made = timed.groupBy(F.window("_at", width)).agg(*aggregates)
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in made.columns if c != "window"])
