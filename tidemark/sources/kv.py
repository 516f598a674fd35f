"""A key-value table as a Spark data source with filter push-down.

Options: path (a Parquet dataset that stands for the store), hash, sort (key
names), segments (of a scan; by default by the rows, as many as SEGMENTS for an
endpoint), endpoints, page (rows of a page).  A read is classified to Get, Query or
Scan steps; each step is a partition, a Scan has one for each segment: a share of the
store's row groups.  Comparisons, IN and null tests are applied by the read; all
filters are evaluated by Spark again.

The Parquet dataset stands in for a store behind a network, which the workers open
themselves: its path must be one that pyarrow can open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import StructType

from ..plans.access_path import Get, Query, Scan, classify

#: Defaults (fixed values): segments of an endpoint, target rows of a worker, most segments.
SEGMENTS, ROWS, MOST = 10, 1000, 1_000_000
#: Rows of a page: a store's page has 100, a Parquet file's batch is better larger.
PAGE = 10_000
_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def segments(rows: int, endpoints: int = 1, most: int = MOST) -> int:
    """How many segments a scan of that many rows gets."""
    return max(1, min(rows // max(1, endpoints) // ROWS, SEGMENTS * endpoints, most, MOST))


class Step(InputPartition):
    def __init__(self, step: Get | Query | Scan, segment: int = 0, of: int = 1) -> None:
        self.step, self.segment, self.of = step, segment, of


def predicate(f: Filter) -> tuple | None:
    """A pushed filter as a predicate; None for what the read does not know."""
    if type(f) in _OPS and len(f.attribute) == 1:
        return (_OPS[type(f)], f.attribute[0], f.value)
    if isinstance(f, (IsNull, IsNotNull)) and len(f.attribute) == 1:
        return ("is null" if isinstance(f, IsNull) else "is not null", f.attribute[0])
    if isinstance(f, In) and len(f.attribute) == 1:
        return ("or", *(("=", f.attribute[0], v) for v in f.value))
    if isinstance(f, Not) and isinstance(f.child, EqualTo) and len(f.child.attribute) == 1:
        return ("<>", f.child.attribute[0], f.child.value)
    return None


def expression(p: tuple | None):
    """A predicate as pyarrow's; None: everything."""
    import pyarrow.dataset as ds

    if p is None:
        return None
    op, *args = p
    if op in ("and", "or"):
        parts = [x for x in map(expression, args) if x is not None]
        return None if not parts or op == "or" and len(parts) < len(args) else reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    field = ds.field(args[0])
    if op in ("is null", "is not null"):
        return field.is_null() if op == "is null" else field.is_valid()
    return {"=": field.__eq__, "<>": field.__ne__, "<": field.__lt__, "<=": field.__le__, ">": field.__gt__, ">=": field.__ge__}[op](args[1])


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (own := predicate(f)) is not None:
                self.filters.append(own)
            yield f  # Spark keeps every filter

    def plan(self) -> list[Get | Query] | Scan:
        return classify(("and", *self.filters) if self.filters else None, self.options["hash"], self.options.get("sort"))

    def partitions(self) -> list[Step]:
        found = self.plan()
        if isinstance(found, Scan):
            n = int(self.options.get("segments") or segments(self.rows(), int(self.options.get("endpoints", 1))))
            return [Step(found, i, n) for i in range(n)]
        return [Step(s) for s in found]

    def rows(self) -> int:
        import pyarrow.dataset as ds

        return ds.dataset(self.options["path"]).count_rows()  # of the footers

    def read(self, partition: Step) -> Iterator:
        import pyarrow.dataset as ds

        data, step, hash_key, sort_key = ds.dataset(self.options["path"]), partition.step, self.options["hash"], self.options.get("sort")
        if isinstance(step, Get):
            wanted = [("=", hash_key, step.hash)] + ([("=", sort_key, step.sort)] if step.sort is not None else [])
        elif isinstance(step, Query):
            wanted = [("=", hash_key, step.hash), *((op, sort_key, v) for op, v in step.sort), *step.attributes]
        else:
            wanted = list(step.filters)
        wanted = expression(("and", *wanted)) if wanted else None
        groups = [g for fragment in data.get_fragments() for g in fragment.split_by_row_group()]
        for group in groups[partition.segment :: partition.of]:
            yield from group.to_batches(schema=data.schema, columns=[f.name for f in self.schema.fields], filter=wanted, batch_size=int(self.options.get("page", PAGE)))


class KeyValue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kv"

    def schema(self) -> StructType:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"]).schema)

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyValue)
