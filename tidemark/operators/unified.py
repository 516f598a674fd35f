"""The unified table: one timestamp-ordered metric over the recent store and the archive.

From the oldest recent window that a query needs, the recent store wins; the
archive gives what is before.  Names are resolved while reading: a field's value
is the first non-null of its user name, its aliases and its canonical id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Metric
from ..plans.intervals import ALL, Intervals, bounds
from ..sources.archive import METRIC, ORG, TIMESTAMP, Archive
from ..sources.nearline import IDS, KEY, SORT, Nearline, partition_key
from ..types import cast, spark_type

RADIO = "_fm"


def resolve(rows: DataFrame, metric: Metric, *, radio: bool = False, strict: bool = True, hidden: tuple[str, ...] = (ORG, METRIC)) -> DataFrame:
    """timestamp, then each field of the metric by its user name; radio: also _fm, a map of the unknown columns as text."""
    there = {c.lower(): c for c in rows.columns}

    def value(field) -> Column:
        own = [F.col(f"`{there[n.lower()]}`") for n in field.inputs() if n.lower() in there]
        if not own:
            return F.lit(None).cast(spark_type(field.type))
        return reduce(lambda a, b: F.coalesce(a, b), [cast(c, field.type, strict=strict) for c in own])

    known = {n.lower() for f in metric.fields for n in f.inputs()} | {TIMESTAMP, *hidden, "write_time"}
    out = [F.col(TIMESTAMP).cast("long").alias("timestamp")]
    if radio:
        unknown = [c for c in rows.columns if c.lower() not in known and not _directory(c)]
        pairs = [x for c in unknown for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        out.append(F.map_filter(held, lambda k, v: v.isNotNull()).alias(RADIO))
    return rows.select(*out, *[value(f).alias(f.name) for f in metric.fields])


def _directory(name: str) -> bool:
    return name.startswith("_fd") and name[3:].isdigit()


def expand(items: DataFrame, *, ids: str = IDS) -> DataFrame:
    """One row for each event id of an item: map columns give that event's value, others are repeated.

    Items of null or no ids have no event.  Conditions on other columns are pushed below by Catalyst.
    """
    maps = {f.name for f in items.schema.fields if f.dataType.typeName() == "map"}
    rows = items.withColumn("_event", F.explode(ids))
    return rows.select(*[F.try_element_at(F.col(f"`{c}`"), F.col("_event")).alias(c) if c in maps else F.col(f"`{c}`") for c in items.columns if c != ids])


def split_key(items: DataFrame, names: tuple[str, ...], pattern: str, *, key: str = KEY, types: tuple[str, ...] = ()) -> DataFrame:
    """Named columns from the groups of a compound key; the key stays."""
    kinds = types or ("string",) * len(names)
    return items.select("*", *[F.regexp_extract(F.col(key).cast("string"), pattern, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(zip(names, kinds, strict=True))])


def columns_of(metric: Metric, *, radio: bool = False) -> str:
    """The schema of the metric's unified table."""
    return ", ".join(["timestamp long", *([f"{RADIO} map<string,string>"] if radio else []), *(f"`{f.name}` {spark_type(f.type).simpleString()}" for f in metric.fields)])


def unified(spark: SparkSession, metric: Metric, *, nearline: Nearline | None = None, archives: tuple[Archive | DataFrame, ...] = (), predicate: tuple | None = None, radio: bool = False, strict: bool = True, ordered: bool = False) -> DataFrame:
    """All rows of the metric that predicate may need (the predicate itself is the caller's to apply).

    archives: stores, or frames of stored rows.  If every source is pruned the
    result is empty, with the metric's columns.
    """
    wanted: Intervals = bounds(predicate)
    branches: list[DataFrame] = []
    boundary = None
    if nearline is not None:
        windows = nearline.surviving(spark, wanted)
        boundary = min((w.start for w in windows), default=None)
        for w in windows:
            items = nearline.read(spark, w).where(F.col(KEY) == partition_key(metric))
            rows = expand(items).withColumnRenamed(SORT, TIMESTAMP)
            branches.append(resolve(rows, metric, radio=radio, strict=strict, hidden=(KEY,)))
    for source in archives:
        rows = source if isinstance(source, DataFrame) else source.read(spark, metric, wanted, boundary, radio=radio)
        if rows is None:
            continue
        rows = rows.where((F.col(ORG) == metric.org) & (F.col(METRIC) == metric.metric_id))
        if boundary is not None:
            rows = rows.where(F.col(TIMESTAMP).cast("long") < boundary)
        branches.append(resolve(rows, metric, radio=radio, strict=strict))
    if wanted != ALL:  # what is pruned by window and day is exact in rows as well
        within = reduce(lambda a, b: a | b, [F.col("timestamp").between(a, b) for a, b in wanted.parts], F.lit(False))
        branches = [b.where(within) for b in branches]
    if not branches:
        return spark.createDataFrame([], columns_of(metric, radio=radio))
    out = reduce(lambda a, b: a.unionByName(b), branches)
    return out.orderBy("timestamp") if ordered else out
