"""Archived rows: directories of JSON or Parquet files, one for each day."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..catalog import Metric
from ..plans.intervals import MAX, MIN, Intervals

#: Columns that every stored row has (fixed values).
ORG, METRIC, TIMESTAMP, WRITTEN = "companykey", "metrictype", "timestamp", "write_time"
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Archive:
    """<base>/0/<format>/<org>/<metric id>/<yyyy-mm-dd>/files"""

    base: str
    format: str = "parquet"

    def path(self, metric: Metric) -> str:
        return f"{self.base}/0/{self.format}/{metric.org}/{metric.metric_id}"

    def days(self, spark: SparkSession, metric: Metric) -> list[str]:
        """The day directories that are there, by the Hadoop file system of the path."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(metric))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())

    def read(self, spark: SparkSession, metric: Metric, wanted: Intervals, before: int | None = None, radio: bool = False) -> DataFrame | None:
        """Rows of the days that `wanted` meets and that begin before `before`; None if there is none.

        Days are pruned inclusively: the exact comparison stays in the plan above.
        """
        days = [d for d in self.days(spark, metric) if _meets(d, wanted) and (before is None or _start(d) < before)]
        if not days:
            return None
        paths = [f"{self.path(metric)}/{d}" for d in days]
        if self.format == "json":
            # Schema on read: every name the fields may have, as text, so nothing is read to infer it (but where
            # unknown names are asked for).  Rows or arrays of rows in a line can be split; days whose files are
            # laid out over lines cannot.
            spread = [p for p in paths if _spread(spark, p)]
            lines = [p for p in paths if p not in spread]
            frames = []
            for own, multi in ((lines, False), (spread, True)):
                if own:
                    reader = spark.read.option("multiLine", multi).option("primitivesAsString", True)
                    frames.append(reader.json(own) if radio else reader.schema(schema(metric)).json(own))
            return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)
        # Files of different days may have different columns and types: their footers tell.
        return spark.read.option("mergeSchema", True).parquet(*paths)


def _spread(spark: SparkSession, folder: str) -> bool:
    """Whether a day's JSON is laid out over lines: its first file's first line begins a value and does not end it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
    if not names:
        return False
    file = fs.open(min(names, key=lambda n: n.toString()))
    try:
        head = bytes(file.readNBytes(256)).lstrip()
    finally:
        file.close()
    line, end, _ = head.partition(b"\n")
    return bool(end) and line.rstrip() in (b"[", b"{", b"[{")


def _start(day: str) -> int:
    try:
        return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.UTC).timestamp() * 1000)
    except ValueError:
        return MIN


def _meets(day: str, wanted: Intervals) -> bool:
    low = _start(day)
    return wanted.meets(low, MAX if low == MIN else low + DAY_MS - 1)


def schema(metric: Metric) -> T.StructType:
    """Every column a stored row of the metric may have, as text."""
    names = [n for f in metric.fields for n in f.inputs()]
    return T.StructType([T.StructField(ORG, T.StringType()), T.StructField(METRIC, T.StringType()), T.StructField(TIMESTAMP, T.StringType()), *(T.StructField(n, T.StringType()) for n in dict.fromkeys(names))])
