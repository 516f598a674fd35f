"""The recent store: one key-value table for each time window.

A window's table is named <prefix>_<start ms>_<end ms>.  Its items have a
partition key (org and metric id), a sort key (the timestamp), the ids of the
events at that time and, for each field, a map from event id to value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..catalog import Metric
from ..plans.intervals import Intervals

KEY, SORT, IDS = "pk", "ts", "ids"


@dataclass(frozen=True)
class Window:
    name: str
    start: int
    end: int  # exclusive


def window(name: str) -> Window | None:
    found = re.fullmatch(r".*_(\d+)_(\d+)", name)
    return Window(name, int(found[1]), int(found[2])) if found else None


def readable(spark: SparkSession, fs, path) -> bool:
    """Whether the caller may read a table; one that may not is hidden, any other failure is an error."""
    try:
        fs.access(path, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsAction.READ_EXECUTE)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "AccessControlException":
            return False
        raise
    return True


@dataclass
class Nearline:
    """base: a folder of Parquet tables named like windows; tables: frames by name, instead."""

    base: str | None = None
    prefix: str = "nl"
    pattern: str = ".*"
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def windows(self, spark: SparkSession) -> list[Window]:
        """Tables whose name begins with the prefix and matches the pattern; a bad pattern is an error."""
        try:
            wanted = re.compile(self.pattern)
        except re.error as e:
            raise ValueError(f"bad table pattern {self.pattern!r}: {e}") from e
        names = list(self.tables)
        if self.base:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.base)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            names += [s.getPath().getName() for s in fs.listStatus(path) if readable(spark, fs, s.getPath())] if fs.exists(path) else []
        found = [window(n) for n in names if n.startswith(self.prefix) and wanted.fullmatch(n)]
        return sorted((w for w in found if w), key=lambda w: (w.start, w.end))

    def surviving(self, spark: SparkSession, wanted: Intervals) -> list[Window]:
        return [w for w in self.windows(spark) if wanted.meets(w.start, w.end - 1)]

    def read(self, spark: SparkSession, w: Window) -> DataFrame:
        return self.tables[w.name] if w.name in self.tables else spark.read.parquet(f"{self.base}/{w.name}")


def partition_key(metric: Metric) -> str:
    return f"{metric.org}{metric.metric_id}"
